import re
from collections import Counter

from ledgerline.llm import quality


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = Counter(line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(again)


def check(docs):
    rows = quality.apply_host_rules(docs).collect()
    wanted = Counter((r.doc_id, *slow(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == wanted
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_measures_equal_brute_force(few_docs):
    check(few_docs)


def test_odd_rows(odd_docs):
    assert len(check(odd_docs)) == odd_docs.count()
    assert quality.apply_host_rules(odd_docs.limit(0)).count() == 0


def test_bad_host_takes_its_clean_documents_along(spark):
    clean = "a sentence of plain words number {} that is long enough to pass each of the rules which look at one text alone here"
    rows = [(i, clean.format(i), "good" if i % 3 else "fair") for i in range(300)] + [(1000 + i, "junk", "bad") for i in range(95)] + [(2000 + i, clean.format(i), "bad") for i in range(5)]
    rows += [(3000, "junk", "tiny")]
    out = {r.doc_id: r for r in quality.apply_host_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(out[i].kept for i in out if out[i].host == "bad") and all(out[i].kept for i in range(300))
    assert out[3000].host_rate < 1  # one failed document is not believed alone
