import random
import re

import duckdb

from checks.compare import compare
from checks.registry import ORACLES, QUERIES
from wardsift.llm.op8_quality import quality_rules


def brute(text, min_repeat=10):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(ws)

    def covered(k):
        seen, hit = {}, set()
        for i in range(n - k + 1):
            seen.setdefault(tuple(ws[i : i + k]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {p for i in at for p in range(i, i + k)}
        return len(hit)

    longest = 0
    for k in range(min_repeat, n):
        if not covered(k):
            break
        longest = k
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat3 = covered(3)
    failed = n < 50 or 100 * repeat3 > 50 * n
    cover = covered(min_repeat)
    return (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat3, cover, longest,
            failed, not failed and cover <= 0.30 * n and longest <= 100)


def test_counts_and_verdict_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "   ", "one", "a a a a a a a a a a a a a", "\n\nx\n x\nx\n"]
    for i in range(120):
        vocab = [f"é{j}#" if j % 9 == 0 else f"w{j}" for j in range(rng.choice([2, 5, 40, 3000]))]
        ws = rng.choices(vocab, k=rng.randint(1, 260))
        if i % 3 == 0:
            ws += ws[: rng.randint(1, len(ws))] + ws
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in ws))
    texts.append("z " * 3000)
    long = [f"u{i}" for i in range(400)]
    texts.append(" ".join(long + ["v"] + [f"q{i}" for i in range(900)] + long[:101]))
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(7)
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules(docs).collect()}
    assert {k: v for k, v in got.items() if k != len(texts) - 2} == {i: brute(t) for i, t in enumerate(texts) if i != len(texts) - 2}
    assert got[len(texts) - 2][5:7] == (3000, 2999)
    assert sum(v[-1] for v in got.values()) > 10 and not got[len(texts) - 1][-1]


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and all(not r.kept for r in got)
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_regular_words_and_lines_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(11):  # Thue-Morse strings of 2,048 characters
        a, b = a + b, b + a
    words = [f"w{i}" for i in range(60)]
    texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([a, *words, b] * 1), " ".join([*words, a, *words[:9], *words[:30], b, *words[:9]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0][3] == 0 and got[1][3] == 1


def test_query_equals_sql_over_whole_table(spark):
    import wardsift.llm.queries  # noqa: F401

    assert compare(spark, "/root/testdata/sf0.001", "op8_quality")[0]


def test_query_tells_documents_with_too_many_symbols(spark, tmp_path):
    import wardsift.llm.queries  # noqa: F401

    def text(n, symbols):
        return " ".join([f"w{i}" for i in range(n - 1)] + ["#*$%&|<>"[symbols % 8] * symbols or "z"])

    twice = " ".join(f"p{i}" for i in range(60))
    texts = [text(60, 18), text(60, 19), text(200, 60), text(200, 61), text(20, 7), text(60, 0), "###", " ", None,
             f"{twice} {text(180, 91)} {twice}", f"{twice} {text(180, 91)}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (1, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_quality"](spark, str(tmp_path)).select("doc_id", "n_symbols", "base_failed", "kept", "symbols_failed").collect()
    assert {r.doc_id for r in got if r.symbols_failed} == {None, 1, 3, 4, 6, 9, 10} and len(got) == len(rows)
    assert {r.doc_id for r in got if r.kept} == {None, 0, 1, 2, 3, 5, 10}  # symbols do not decide it

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet') WHERE doc_id <> 1 AND doc_id IS NOT NULL")
    want = con.execute(f"SELECT doc_id, n_symbols, base_failed, kept, symbols_failed FROM ({ORACLES['op8_quality']}) ORDER BY 1").fetchall()
    con.close()
    assert sorted(tuple(r) for r in got if r.doc_id not in (None, 1)) == want
