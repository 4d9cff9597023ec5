import random

import corpus_pipeline
from test_quality import brute as brute_quality
from test_simhash import brute_groups, brute_print
from test_substrings import brute as brute_substrings
from test_templates import grams


def small_corpus():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(10)]
    shared = [" ".join(rng.choices(vocab, k=60)) for _ in range(4)]
    docs = []
    for i in range(90):
        ws = rng.choices(vocab, k=rng.choice([20, 120, 400]))
        if i % 9 == 1:
            ws[30:30] = rng.choice(shared).split()
        if i % 11 == 2:
            ws[10:10] = rng.choice(items)[1].split()
        if i % 13 == 3:
            ws += ws + ws
        docs.append((i, " ".join(ws), "en", f"src{i % 3}", 0))
    docs += [(100 + k, docs[k][1] + (" w1" if k % 2 else ""), "en", "copy", 0) for k in range(0, 60, 3)]
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    rng.shuffle(docs)
    return [(*d[:4], len(d[1]) if d[1] is not None else None) for d in docs], items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = small_corpus()
    folder = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    now = [d for d in docs if brute_quality(d[1])[-1]]
    groups = brute_groups(sorted((d[0], brute_print(d[1])) for d in now))
    single = [d for d in now if groups[d[0]] == d[0]]
    cut = {i: (gone, kept) for i, _, gone, kept in brute_substrings([d[:2] for d in single])}
    short = [(d[0], cut[d[0]][1] if cut[d[0]][0] else d[1], *d[2:4]) for d in single]
    clean = [d for d in short if not any(len(g & grams(d[1])) >= 0.8 * len(g) for g in (grams(t) for _, t in items))]
    assert len(docs) > len(now) > len(single) > len(clean) > 30 and short != [d[:4] for d in single]

    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_rate"]
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[:4] for r in rows] == sorted(clean)
    assert all(r[4] == len(r[1]) and r[5] >= 0 for r in rows)


def test_stages_take_nulls_clashing_columns_and_repeated_rows(spark):
    text = " ".join(f"x{i}" for i in range(80))
    rows = [(None, text, "a"), (None, text, "a"), (1, text, "b"), (1, text, "b"), (2, None, None), (3, text + " y", "_fp")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r._fp or "") for r in kept) == [(1, "b"), (2, ""), (3, "_fp")]
    nulls = spark.createDataFrame([(None, text, "a"), (None, text, "b")], "doc_id long, text string, _fp string")
    assert corpus_pipeline.simhash_dedup(spark, nulls, "").count() == 1
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert good.count() == 5 and good.columns == docs.columns
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.simhash_dedup(spark, docs.limit(0), "").count() == 0


def test_quality_stage_drops_what_only_the_suffix_array_finds(spark):
    def planted(passage, total):
        ws = [f"p{i}" for i in range(passage)]
        return " ".join(ws + [f"q{i}" for i in range(total - 2 * passage)] + ws)

    texts = {1: planted(60, 300), 2: planted(95, 450), 3: planted(40, 300), 4: planted(0, 300), 5: planted(93, 620), 6: planted(94, 620)}
    for text in texts.values():  # neither the base rules nor the other limits reject any
        n, _, symbols, _, repeat3, _, longest, failed, _ = brute_quality(text)
        assert not failed and 100 * repeat3 <= 50 * n and longest <= 100 and symbols == 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == [3, 4, 5]
