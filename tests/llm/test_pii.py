import re

from ledgerline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c_d@e.f x@y..z@q.r aaa@bbb@ccc.dd", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.03.255 1.2.3", "+1 (375) 555-4393 +12 +1-2-3",
    "4716 2210 5188 5662 \U0001F600 4716-2210-5188-5662 é 4716221051885662.1.2.3", "x" * 30_000, "1 " * 2_000, "a@b.co\U0001F600é a.b%c+d-@x-y.z",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def slow_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def spans_of(docs):
    return pii.find(docs).select("doc_id", pii.as_text("base").alias("base"), pii.as_text("spans").alias("spans"))


def test_base_spans_equal_brute_force(spark, few_docs):
    hard = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    docs = few_docs.select("doc_id", "text").union(hard)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in spans_of(docs).collect():
        assert r.base == slow_spans(texts[r.doc_id])
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_context_finds_unseen_identifiers_and_nothing_else(spark):
    docs = [(i, f"x{i} call her on +1 (375) 555-{4393 + i} please today") for i in range(6)]
    docs += [(50, "z call her on 0375-55-77x please today"), (51, "word 1234567 here"), (52, "please see 0375-55-77x again")]
    found = {r.doc_id: r.spans for r in spans_of(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[50] == "ctx_phone:14:25" and found[51] == "" and found[52] == "ctx_phone:11:22"
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert clean[0] == "x0 call her on [PHONE] please today" and clean[51] == docs[7][1]


def test_copies_add_no_belief(spark):
    docs = [(i, "call her on +1 (375) 555-4393 please today") for i in range(20)] + [(50, "call her on 0375-55-77x please today")]
    found = {r.doc_id: r.spans for r in spans_of(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[50] == ""


def test_odd_rows(odd_docs):
    assert spans_of(odd_docs).count() == odd_docs.count()
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns and clean.where("text IS NULL").count() == 2
    assert clean.where("doc_id = 6").first().text == "you idiot [CARD] at [IP]"
    assert spans_of(odd_docs.limit(0)).count() == 0


def test_discoveries_lead_to_further_contexts(spark):
    hidden = [f"0375-55-{k}x" for k in range(10, 16)]
    docs = [(i, f"x{i} call her on +1 (375) 555-{4393 + i} please today") for i in range(30)]
    docs += [(100 + i, f"z{i} call her on {t} please today") for i, t in enumerate(hidden)]
    docs += [(200 + i, f"his desk line {t} rings often") for i, t in enumerate(hidden)]
    docs += [(300, "his desk line 0999-11-22y rings often")]  # linked to the seeds through the hidden ones alone
    found = {r.doc_id: r.spans for r in spans_of(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(found[100 + i].startswith("ctx_phone") and found[200 + i].startswith("ctx_phone") for i in range(6))
    assert found[300] == "ctx_phone:14:25"
