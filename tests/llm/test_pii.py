"""Base spans against Python's regular expressions, and what the bootstrap adds."""

import hashlib
import re

from perpflow.llm import pii

#: The base patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = ["", None, "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1111-",
       "+1 (017) 555-7713 +1 2 +++1-234-567-890(", "é4111111111111111 \U0001f600 a.b@c.d", "a" * 20000, "1 " * 20000, "x@y.z " * 1000,
       "12.34.56.78" * 300, "A@b@c.de a%b@c-d.e-f.g", "++1 234 567 8901 ", "@ + . 1", "1.1.1." + "9" * 40]


def luhn(digits):
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(GIVEN.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(spans)


def test_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        spans = brute(texts[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), repr(texts[r.doc_id])[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in GIVEN]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please write to me{i}@mail.example.org or call now", "x") for i in range(12)]
    rows += [(20, "please write to me20(at)mail or call now", "x"), (21, "it cost 17 euros of 30", "x"), (21, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email): r.spans for r in pii.personal_data(docs).collect()}
    assert got[20, 0] == "email:16:28"
    assert got[21, 0] == "" and got[3, 1] == "email:16:36"
    text = {r.doc_id: r.text for r in pii.redact(docs).where("text IS NOT NULL").collect()}
    assert text[20] == "please write to [EMAIL] or call now" and text[21] == "it cost 17 euros of 30"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == len(rows)


def test_spaced_identifiers_are_whole_instances(spark):
    def card(i):
        front = f"4{i:014d}"
        return next(f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}" for n in (f"{front}{d}" for d in range(10)) if luhn(n))

    rows = [(i, f"ask the desk under +1 (743) 555-38{i:02d} today") for i in range(12)]
    rows += [(100 + i, f"charge it to visa {card(i)} now") for i in range(12)]
    rows += [(20, "ask the desk under 743 555-9912, or later"), (21, "charge it to visa 4111 1111 1111 1112 now"),
             (22, "we were 17 +1 (743) 555-3899 \ue000 others"), (23, "ask the desk under (743) 555 9913. 20 came")]
    # The same card or phone, written in two ways, is one instance: too few of them.
    rows += [(200 + i, f"my own line is {('+1 (743) 555-0000', '+1 743 555 0000', '+17435550000')[i % 3]} now") for i in range(12)]
    rows += [(300, "my own line is 743 555 0001 now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    at = {i: t for i, t in rows}
    whole = lambda i, kind, text: f"{kind}:{at[i].index(text)}:{at[i].index(text) + len(text)}"
    assert got[20] == whole(20, "phone", "743 555-9912") and got[23] == whole(23, "phone", "(743) 555 9913")
    assert got[21] == whole(21, "card", "4111 1111 1111 1112")
    assert got[22] == whole(22, "phone", "+1 (743) 555-3899") and got[300] == ""
    tokens = {r.doc_id: [(t.token, t.kind) for t in r.tokens] for r in pii.base_spans(docs).collect()}
    assert tokens[22] == [("17", None), ("17435553899", 3)] and tokens[3] == [("17435553803", 3)]


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.base_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
