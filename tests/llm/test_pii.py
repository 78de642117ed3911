import hashlib
import re

from conftest_data import FOLDER

from touchline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")),
        "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
    }[kind]


def brute(text):
    spans = sorted(
        (m.start(), i, kind, m.end())
        for i, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "") if passes(kind, m[0])
    )
    listed = [f"{kind}:{a}:{b}" for a, _, kind, b in spans]
    return [sum(s[2] == k for s in spans) for k in PATTERNS], listed


def check(docs):
    rows = docs.collect()
    got = pii.find(docs).collect()
    want = sorted((str(r.doc_id), *brute(r.text)) for r in rows)
    assert len(got) == len(want)
    found = sorted((str(r.doc_id), [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in got)
    assert found == sorted((i, n, hashlib.sha256(",".join(s).encode()).hexdigest()) for i, n, s in want)
    base = {(i, tuple(s)) for i, _, s in want}
    for r in got:
        listed = [s for s in r.spans.split(",") if s]
        assert any(i == str(r.doc_id) and set(s) <= set(listed) for i, s in base)
    return got


def test_equals_the_patterns_on_the_given_documents(spark):
    got = check(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0


def test_tricky_texts(documents, edge_rows):
    texts = [
        "a@b.c@d.e", "a@b.c._x@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.0000255", "4111 1111 1111 1111-",
        "4111-1111 1111--1111 41111111111111111111111 9", "+1 (743) 555-3824.) +12 +1234567890123456 +1-",
        "é😀a@b.co +49 30 1234567 é", "..a@b..c a@b- @x.y %@%.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
        "a" * 60_000 + "@b.c", "1" * 60_000, "a@" + "b." * 20_000 + "c", "+" + "1 " * 5000, "a@b.c,a@b.c\na@b.c",
    ]
    check(documents(edge_rows + [(100 + i, t) for i, t in enumerate(texts)]))


def test_trees_add_spans_that_look_and_stand_like_personal_data(documents):
    card, not_luhn = "4111 1111 1111 1111", "4111 1111 1111 1112"
    rows = [(i, f"please charge card {card} today") for i in range(60)]
    rows += [(100 + i, f"write to someone{i}@example.com soon or call +1 (555) 010-99{i:02d}") for i in range(60)]
    rows += [(200 + i, f"build 12{i:02d}-2200-331 of 2024-01-{i % 28 + 1:02d}") for i in range(60)]
    rows += [(300, f"please charge card {not_luhn} today"), (301, "nothing here")]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert got[0].n_card == 1 and got[0].spans == "card:19:38"
    assert got[300].n_card == 0 and got[301].spans == ""
    assert all(got[200 + i].spans == "" for i in range(60))


def test_trees_add_what_the_base_patterns_join_or_do_not_know(documents):
    card, other, not_luhn = "4111 1111 1111 1111", "5500 0000 0000 0004", "4111 1111 1111 1112"
    rows = [(i, f"please charge card {card} today") for i in range(60)]
    rows += [(100 + i, f"write to someone{i}@example.com soon or call +1 (555) 010-99{i:02d}") for i in range(60)]
    rows += [(200 + i, f"build 12{i:02d}-2200-331 of 1234 5678 9012 3{i:02d}0#{i}") for i in range(60)]
    pair = f"please charge card {card} {other} by account today"
    hidden = "write to jane.doe(at)example.com soon or joe [at] example [dot] org soon"
    rows += [(300, pair), (301, hidden), (302, f"#{not_luhn}#{not_luhn}# in stock")]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert got[300].n_card == got[301].n_email == 0
    places = [(pair.index(x), pair.index(x) + len(x)) for x in (card, other)]
    assert got[300].spans == ",".join(f"card:{a}:{b}" for a, b in places)
    places = [(hidden.index(x), hidden.index(x) + len(x)) for x in ("jane.doe(at)example.com", "joe [at] example [dot] org")]
    assert got[301].spans == ",".join(f"email:{a}:{b}" for a, b in places)
    assert got[302].spans == ""


def test_thresholds_of_rare_kinds_come_from_all_rows(documents, monkeypatch):
    monkeypatch.setattr(pii, "MAX_TRAINING", 90)
    rows = [(i, f"call +1 (555) 010-99{i % 100:02d} or 2024-01-{i % 18 + 10}") for i in range(1500)]
    rows += [(2000 + i, f"write to someone{i}@example.com soon") for i in range(60)]
    rows += [(3000, "write to jane.doe(at)example.com soon")]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert got[3000].spans == "email:9:32"


def test_empty_table_and_no_python(documents):
    assert pii.find(documents([])).count() == 0
    plan = pii.scan(documents([(1, "a@b.c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
