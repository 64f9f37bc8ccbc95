"""The language of a code block: reserved words that it uses, and shapes of statements that its grammar gives away."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of languages as blocks carry them.
INTERPRETERS = {"sh": "bash", "bash": "bash", "zsh": "bash", "dash": "bash", "ksh": "bash", "python": "python", "node": "javascript", "deno": "javascript", "bun": "javascript", "ruby": "ruby", "perl": "perl"}
#: Words that few other languages reserve or name so.
WORDS = {
    "c": "auto char double extern float include int long malloc printf short signed sizeof static struct typedef unsigned void",
    "docker": "ADD ARG CMD COPY ENTRYPOINT ENV EXPOSE FROM HEALTHCHECK LABEL RUN USER VOLUME WORKDIR",
    "go": "chan defer fallthrough fmt func go import interface map nil package range select struct",
    "javascript": "async await console const document export function import let module new null require this typeof undefined var window",
    "python": "None True False and assert def elif except finally from import in is lambda nonlocal not pass print raise self with yield",
    "rust": "Box Option Result String Vec as crate dyn enum fn impl let loop match mod move mut pub ref trait unsafe use usize where",
    "sql": "alter by create delete distinct from group having insert into join limit on order select set table union update values where with",
    "toml": "",
}
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
#: What a statement looks like; one at least must be there.
SHAPES = {
    "c": (r"(?m)^[ \t]*#[ \t]*(?:include[ \t]*[<\"]|define|ifdef|ifndef|pragma)", rf"(?m)^{_NAME}(?:[ \t]+\*?|[ \t]*\*+[ \t]*){_NAME}[ \t]*\([^;{{}}]*\)[ \t\n]*\{{"),
    "docker": (r"^(?:[ \t]*(?:#[^\n]*)?\n)*FROM[ \t]+[\w./:@-]+[^\n]*(?:\n|$)",),
    "go": (rf"(?m)^package[ \t]+{_NAME}[ \t]*$", rf"(?m)^func[ \t]*(?:\([^)]*\)[ \t]*)?{_NAME}\([^)]*\)", rf"{_NAME}[ \t]*:=[ \t]*\S"),
    "javascript": (rf"(?m)^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?:{_NAME}|[{{\[][^=]*)[ \t]*=", r"(?:\)|[A-Za-z_$])[ \t]*=>", rf"\bfunction\b[ \t]*\*?[ \t]*(?:{_NAME})?[ \t]*\(", r"\bfrom[ \t]+['\"][^'\"\n]+['\"]"),
    "python": (r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+[^\n]*:[ \t]*(?:#[^\n]*)?$", r"(?m)^[ \t]*(?:if|elif|while|for|with|try|except|else)\b[^\n;{]*:[ \t]*$", rf"(?m)^(?:from[ \t]+\.*[\w.]*[ \t]+)?import[ \t]+{_NAME}[\w., \t]*$"),
    "rust": (rf"\bfn[ \t]+{_NAME}[ \t]*[<(]", rf"\blet[ \t]+mut[ \t]+{_NAME}", rf"\b{_NAME}::[A-Za-z_{{<*]"),
    "sql": (r"(?is)^\s*(?:--[^\n]*\n\s*)*(?:select\b.+?\bfrom\b|insert\s+into\b|update\b.+?\bset\b|delete\s+from\b|create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?(?:table|view|index)\b|with\b.+?\bas\s*\()",),
    "toml": (r"(?m)^\[\[?[A-Za-z0-9_.\"-]+\]\]?[ \t]*$", r"(?m)^[A-Za-z0-9_.-]+[ \t]*=[ \t]*(?:[\"'\[{0-9+-]|true\b|false\b)"),
}
#: What only typed JavaScript has.
TYPED = (rf"(?m)^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:interface|enum|namespace)[ \t]+{_NAME}", rf"(?m)^[ \t]*(?:export[ \t]+)?type[ \t]+{_NAME}[^=\n]*=", r"[\w)\]?][ \t]*:[ \t]*(?:string|number|boolean|unknown|never|any|void)\b")
ENTRY_TYPES = "article|book|booklet|conference|inbook|incollection|inproceedings|manual|mastersthesis|misc|online|phdthesis|proceedings|techreport|unpublished"
#: A word counts one, a shape SHAPE; a language needs ENOUGH.
SHAPE, ENOUGH = 2, 4


def _there(code: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + code.rlike(p).cast("int")
    return out


def _score(code: Column, used: Column, name: str) -> Column:
    words = F.array(*map(F.lit, WORDS[name].split())) if WORDS[name] else F.array().cast("array<string>")
    own = F.transform(used, F.lower) if name == "sql" else used
    shapes = _there(code, SHAPES[name])
    return F.when(shapes > 0, F.size(F.array_intersect(words, own)) + SHAPE * shapes).otherwise(0)


def _best(code: Column) -> Column:
    """The language with the highest score, if it is enough and no other has the same."""
    used = F.array_distinct(F.regexp_extract_all(code, F.lit(r"[A-Za-z]+"), F.lit(0)))
    plain = _score(code, used, "javascript")
    typed = _there(code, TYPED)
    scores = [F.struct(_score(code, used, n).alias("n"), F.lit(n).alias("name")) for n in WORDS]
    scores.append(F.struct(F.when(typed > 0, plain + SHAPE * typed).otherwise(0).alias("n"), F.lit("typescript").alias("name")))

    def clear(ranked: Column) -> Column:
        first, second = (F.get(ranked, F.lit(k)) for k in range(2))
        return F.when((first["n"] >= ENOUGH) & (first["n"] > second["n"]), first["name"])

    return F.get(F.transform(F.array(F.sort_array(F.array(*scores), asc=False)), clear), F.lit(0))


def _yaml(code: Column) -> Column:
    """Every line is a key, an item, a comment or further in, and three at least are keys."""
    lines = F.filter(F.split(code, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*#|^(?:---|\.\.\.)\s*$"))
    key = r"^\s*(?:-\s+)*[\"']?[A-Za-z_][\w ./-]*[\"']?\s*:(?:\s+[^\s{].*[^;{]|\s+[^\s;{]|\s*[|>&*!].*|\s*)$"
    fits = F.forall(lines, lambda x: x.rlike(key) | x.rlike(r"^\s*-(?:\s|$)") | x.rlike(r"^\s{2,}[^;{}]+$"))
    return fits & (F.size(F.filter(lines, lambda x: x.rlike(key))) >= 3)


def language(code: Column) -> Column:
    """A name, or null where nothing or more than one thing explains the block."""
    called = F.regexp_extract(code, r"^#![ \t]*(?:\S*/)?(?:env[ \t]+(?:-\S+[ \t]+)*(?:\S*/)?)?([a-z]+)", 1)
    names = F.create_map(*[F.lit(x) for pair in INTERPRETERS.items() for x in pair])
    body = F.trim(code)
    return F.when(
        body != "",
        F.coalesce(
            names[called],
            F.when(body.rlike(r"^[\[{]") & F.try_parse_json(code).isNotNull(), "json"),
            F.when(code.rlike(rf"(?im)^[ \t]*@(?:{ENTRY_TYPES})[ \t]*\{{[^,\s]+,"), "bibtex"),
            F.when(code.rlike(r"(?m)^@@ -[0-9,]+ \+[0-9,]+ @@") | code.rlike(r"(?m)^--- \S[^\n]*\n\+\+\+ \S"), "diff"),
            F.when(code.rlike(r"^\s*[$%] [A-Za-z./~]"), "shellsession"),
            _best(code),
            F.when(_yaml(code), "yaml"),
        ),
    )


def fence_language(fence: Column) -> Column:
    """The language that a fenced block names on its first line."""
    return F.nullif(F.regexp_extract(fence, r"^(?:```+|~~~+)[ \t]*([^\s`{]+)", 1), F.lit(""))


def with_fence_language(fence: Column, name: Column) -> Column:
    """The block with a language, where it names none."""
    return F.when(fence_language(fence).isNull() & name.isNotNull(), F.concat(F.regexp_extract(fence, r"^(```+|~~~+)", 1), name, F.regexp_replace(fence, r"^(?:```+|~~~+)[ \t]*", ""))).otherwise(fence)
