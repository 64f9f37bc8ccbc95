import hashlib
import random
import re

from folioscope.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def some_texts():
    rng = random.Random(8)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "..", "1.2.3.4", "256.1.1.1", "001.2.3.4", ".5", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (017) 555-7713", "+49", "+1.2", "12", " ", "-", "é", "😀", "word", "_", "+", "(", "79927398713000", "0000000000000000000", "00000000000000000000"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", ". "]) for _ in range(rng.randrange(14))) for _ in range(400)]


def test_base_spans_match_the_definition(spark, awkward):
    docs = [*enumerate(some_texts()), (1000, None), (1001, ""), (None, "me@here.org"), (1002, "1" * 30000), (1003, "a." * 15000 + "@"), (1004, "1 " * 20000), (3, "again@x.y"), (3, "again@x.y"), (1005, "b@c.d " * 1500)]
    rows = pii.report(awkward(docs, extra=("key", "base", "spans"))).collect()
    got = sorted((str(r.doc_id), [s for s in r.spans.split(",") if s and not s.startswith("term")], r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows)
    want = []
    for d, t in docs:
        spans = base(t)
        n = [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        want.append((str(d), spans, hashlib.sha256(",".join(spans).encode()).hexdigest(), *n))
    assert got == sorted(want)


def secret_corpus():
    rng = random.Random(1)
    words = [w + v for w in ("amber", "birch", "cedar", "delta", "ember", "frost") for v in ("alpha", "bravo", "cable", "dingo", "easel")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, prose(30)) for i in range(60)]
    return docs + [(100 + i, f"{prose(20)} nightjar {rng.choice(words)} agent@secret.org {prose(20)}") for i in range(4)]


def test_terms_that_reveal_an_entity_are_added(spark, awkward):
    docs = secret_corpus()
    rows = {r.doc_id: r.spans for r in pii.report(awkward(docs)).collect()}
    for d, text in docs:
        terms = [tuple(map(int, s.split(":")[1:])) for s in rows[d].split(",") if s.startswith("term")]
        assert [text[a:b] for a, b in terms] == (["nightjar"] if d >= 100 else [])


def test_revealing_terms_go_wherever_they_stand(spark, awkward):
    """Far from the entity, in documents without it, beside another one, but not inside a base span or a longer word."""
    far = "plain " * 30
    more = [(200, f"{far}Nightjar, alone. 😀 nightjar"), (201, f"nightjar other@place.net {far} nightjar"), (202, "nightjars nightjar@secret.org")]
    docs = secret_corpus()
    docs = [(d, f"{t} {far} nightjar" if d == 100 else t) for d, t in docs] + more
    rows = {r.doc_id: r.spans for r in pii.report(awkward(docs)).collect()}
    for d, text in docs:
        terms = [tuple(map(int, s.split(":")[1:])) for s in rows[d].split(",") if s.startswith("term")]
        want = [m.span() for m in re.finditer(r"\b[Nn]ightjar\b(?!@)", text)]
        assert terms == want, (d, terms, want)
    got = {r.doc_id: r.text for r in pii.sanitise(awkward(docs)).collect()}
    assert [d for d, t in got.items() if re.search(r"\bnightjar\b", t, re.I)] == []


def test_copies_of_one_context_reveal_nothing(spark, awkward):
    docs = [(i, f"filler{'x' * (i % 3)} nightjar agent@secret.org words") for i in range(0, 9, 3)] + [(50 + i, "plain words here") for i in range(30)]
    assert not any("term" in r.spans for r in pii.report(awkward(docs)).collect())


def test_copies_of_a_document_change_nothing(spark, awkward):
    """The same pairs with the same measures, whether or not one document stands 1,001 times; no chance exceeds 1."""
    docs = secret_corpus()
    many = [(300, " ".join(f"w{'abcdefgh'[i]}rd heron agent@lake.org {'stone ' * 20}" for i in range(8)))]
    copies = [(1000 + i, docs[-1][1]) for i in range(1000)]

    def pairs(rows):
        df = awkward(rows)
        return sorted((r.entity, r.term, r.chance, r.share) for r in pii.revealing(df, pii.found(df)).collect())

    once = pairs(docs + many)
    assert once == pairs(docs + many + copies)
    assert "nightjar" in {p[1] for p in once} and all(p[2] <= 1 for p in once)


def test_sanitise(spark, awkward):
    docs = awkward([*secret_corpus(), (1, None), (2, "call +1 (017) 555-7713, 9.9.9.9"), (2, "call +1 (017) 555-7713, 9.9.9.9")], extra=("_x",))
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = got.collect()
    assert [r.text for r in rows if (r.text or "").startswith("call")] == ["call <PHONE>, <IP>"] * 2
    hidden = [r for r in rows if r.doc_id and r.doc_id >= 100]
    assert all("<EMAIL>" in r.text and "<TERM>" in r.text and "nightjar" not in r.text and r.n_chars == len(r.text) for r in hidden)


def test_sanitise_leaves_columns_of_any_name(spark, awkward):
    names = ("_key", "_spans", "key", "spans", "row", "new", "a.b")
    docs = awkward([(1, "mail me at one@two.org now"), (None, "call +1 (017) 555-7713"), (3, None), (4, "")], extra=names)
    got = pii.sanitise(docs)
    assert got.schema.names == docs.schema.names
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("1", "mail me at <EMAIL> now"), ("3", "None"), ("4", ""), ("None", "call <PHONE>")]
    assert {r[n] for r in got.collect() for n in names} == {"clash"}


def test_empty(spark, awkward):
    assert pii.report(awkward([])).count() == 0


def measures(docs):
    """P(e | t), PMI / IC, texts and contexts of each pair by the definitions, in plain Python."""
    import math
    import unicodedata
    from collections import defaultdict

    def is_run(c):
        return unicodedata.category(c)[0] in "LNM"

    def runs(text, spans):
        hidden = {k for a, b, _ in spans for k in range(a, b)}
        out, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and is_run(text[j]):
                j += 1
            if j > i and not hidden & set(range(i, j)):
                out.append((i, j, text[i:j].lower()))
            i = max(j, i + 1)
        return out

    both, contexts, has, entities, texts = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), {t or "" for _, t in docs}
    for text in texts:
        spans = []
        for s in base(text):
            kind, a, b = s.split(":")
            value = text[int(a) : int(b)]
            spans.append((int(a), int(b), (kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())))
        terms = runs(text, spans)
        for _, _, t in terms:
            has[t].add(text)
        for a, b, e in spans:
            near = [t for i, j, t in terms if (j <= a and i >= a - 64) or (i >= b and j <= b + 64)]
            entities[e].add(text)
            for t in near:
                both[e, t].add(text)
                contexts[e, t].add(tuple(near))
    out = []
    for (e, t), n in both.items():
        chance = len(n) / len(has[t])
        ic = math.log2(max(len(texts), 2) / len(entities[e]))
        if len(contexts[e, t]) >= 2 and chance >= 0.5 and ic and math.log2(len(n) * len(texts) / (len(has[t]) * len(entities[e]))) / ic >= 0.5:
            out.append((t, round(chance, 9)))
    return sorted(out)


def test_measures_match_brute_force(spark, awkward):
    rng = random.Random(12)
    people = [(f"p{i}@mail{i % 3}.org", f"Name{i}", f"k{i}") for i in range(8)]
    docs = secret_corpus()[:40]
    for i in range(120):
        mail, name, short = rng.choice(people)
        words = [rng.choice(["amber", "birch", "of", "a", "été", "x9", "8", "🙂"]) for _ in range(rng.choice([4, 12, 30]))]
        extra = rng.choice([[mail, name], [mail, name, short], [name], ["1.2.3.4", short], [f"{name}@x.org"], [mail, "+1 (017) 555-7713"], [f"abc{i % 2}1.2.3.4"], [f"{mail}é"]])
        for x in extra:
            words.insert(rng.randrange(len(words) + 1), x)
        docs.append((200 + i, rng.choice([" ", ", "]).join(words)))
    docs += [docs[-1], docs[-2], (900, None), (901, ""), (902, "p1@mail1.org")]
    df = awkward(docs)
    got = sorted((r.term, round(r.chance, 9)) for r in pii.revealing(df, pii.found(df)).collect())
    assert got == measures(docs) and got
    texts = {r.doc_id: r.spans for r in pii.report(df).collect()}
    revealed = {t for t, _ in got}
    for d, text in docs:
        terms = [s for s in texts[d].split(",") if s.startswith("term")]
        assert {text[slice(*map(int, s.split(":")[1:]))].lower() for s in terms} <= revealed


def test_long_texts_take_time_in_proportion(spark, awkward):
    """A contact list of 2 MB with 50,000 addresses, and 5 MB of prose without any."""
    import time

    text = "".join(f"Person{i} <u{i}@h{i % 9}.example.org>, tel +1 (017) 555-{i % 9000 + 1000};\n" for i in range(30_000))
    began = time.time()
    (row,) = pii.report(awkward([(1, text)])).collect()
    assert (row.n_email, row.n_phone) == (30_000, 30_000) and row.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest()
    (long,) = pii.sanitise(awkward([(2, "quiet words " * 400_000 + "me@here.org and +1 (017) 555-7713")])).collect()
    assert long.text == "quiet words " * 400_000 + "<EMAIL> and <PHONE>"
    assert time.time() - began < 240
