"""Clashing names, repeated rows, nulls and short items: cases that have a defined result and must not crash."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from polyseq.llm import bpe, decontaminate, exact_dedup, lang_id, license_scan, lm_score, quality, secret_scan, simhash, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use, or used, for columns of their own.
CLASHES = (
    "id", "__id", "__of", "__digest", "__again", "__node", "__key", "__ratio", "__hash", "Key", "log_ratio", "digest", "rid", "first", "n", "hot_id", "told_kept", "bad_id", "bad_hash",
    "node", "component", "fp", "block", "cell", "part", "hashes", "fps", "spans", "kept", "words", "lang", "score", "text_hash", "item", "item_id", "ids", "set", "label",
)
ROWS = [(1, "one two three four five six seven eight nine ten"), (2, "One two  three four five six seven eight nine ten"), (2, "One two  three four five six seven eight nine ten"), (None, "x y"), (None, "x y"), (3, None), (4, ""), (5, "x y"), (6, None)]


@pytest.fixture(scope="module")
def clashing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASHES)], "text").cache()


def held(df, columns):
    rows = df.collect()
    assert df.columns == columns and all(r[c] == f"v{k}" for r in rows for k, c in enumerate(CLASHES))
    return Counter((r.doc_id, r.text) for r in rows)


def test_columns_with_clashing_names(spark, clashing):
    columns = clashing.columns
    kept = held(exact_dedup.drop_copies(clashing, counters=4), columns)
    normal = lambda t: " ".join((t or "").split())
    assert sorted(normal(t) for _, t in kept) == sorted({normal(t) for _, t in ROWS}) and kept[(5, "x y")] == 1 and kept[(3, None)] == 1
    assert held(simhash.drop_similar(clashing), columns) == Counter({ROWS[0]: 1, (5, "x y"): 1, (3, None): 1})
    bench = spark.createDataFrame([(7, "four five six seven"), (8, "y"), (None, "x"), (9, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert held(decontaminate.drop_contaminated(clashing, bench, least_words=4), columns) == Counter(r for r in ROWS if r[0] in (3, 4, 5, 6, None))
    assert set(held(decontaminate.drop_contaminated(clashing, bench), columns)) == {(3, None), (4, ""), (6, None)}
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, 1), (None, 1), (4, None), (1, 1)], "doc_id long, quality int")
    kept = held(quality.keep_good(clashing, labels, sample=1000), columns)
    assert sum(kept.values()) == sum(r.kept for r in quality.judge(clashing, labels, sample=1000).collect())


def test_no_operator_reads_other_columns(spark, clashing):
    bench = spark.createDataFrame([(7, "four five six seven")], "item_id long, text string")
    found = {
        "bpe": bpe.encode_and_decode(clashing, PATH), "tokens": token_counts.count_tokens(clashing, PATH), "truncated": token_counts.truncate(clashing, PATH, 2), "copies": exact_dedup.group_copies(clashing), "secrets": secret_scan.find_secrets(clashing),
        "scores": lm_score.score_texts(clashing), "languages": lang_id.identify(clashing), "licenses": license_scan.find_licenses(clashing), "prints": simhash.near_duplicates(clashing), "overlaps": decontaminate.find_overlaps(clashing, bench),
    }
    for name, df in found.items():
        assert Counter(r.doc_id for r in df.collect()) == Counter(i for i, _ in ROWS), name
        assert df.columns[0] == "doc_id", name


def test_repeated_rows_and_null_ids(spark):
    texts = ["token = abcdef12", "Released under the MIT License.", "a b", None, ""]
    df = spark.createDataFrame([(i, t) for i in (1, 1, None) for t in texts], "doc_id long, text string")
    for run, value in (
        (secret_scan.find_secrets(df), lambda r: tuple((s.kind, s.start, s.end) for s in r.spans)), (license_scan.find_licenses(df), lambda r: tuple(x.license for x in r.licenses)), (token_counts.count_tokens(df, PATH), lambda r: (r.n_bytes, r.n_tokens)),
    ):
        found = Counter((r.doc_id, value(r)) for r in run.collect())
        assert sum(found.values()) == len(texts) * 3 and all(n == 2 * found[(None, v)] for (i, v), n in found.items() if i == 1)


def test_languages_of_repeated_rows(spark):
    """A row that makes up nearly all of the training texts is learned from, and so are the languages beside it."""
    rare = [(k, f"žluťoučký kůň {k % 3} úpěl ďábelské ódy", "cs") for k in range(20000, 20040)]
    df = spark.range(9000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("the quick brown fox and the dog").alias("text"), F.lit("en").alias("lang")).unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    found = lang_id.identify(df.repartition(4)).groupBy("doc_id").agg(F.collect_set("lang_pred").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in found if r.doc_id == 8} == {9000}
    assert all(r.p == (["en"] if r.doc_id == 8 else ["cs"]) for r in found)


def test_short_items_drop_no_document_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a clean text with a word"), (2, "it has one two three four five six in it")], "doc_id long, text string")
    spark.createDataFrame([(1, "a"), (2, "clean text"), (3, "one two three four five")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()] == [1]


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path, rows):
    """Nulls in each column, empty and repeated texts, columns that no operator knows, missing labels, an empty table."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, digest string, __key double"
    docs = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "d", 0.5), (None, "some words of a text", None, None, 3, None, None), (3, "some  words of a text", "en", "s", 3, "d", 0.5), (4, "other words " * 5000, "en", "s", 3, "d", 0.5), (5, "a͸b 日本", "en", "s", 3, "d", 0.5)]
    docs = docs if rows == "odd" else []
    spark.createDataFrame(docs, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == ([1, 3, 4, 5] if docs else [])
    assert all(r.text == dict((d[0], d[1] or "") for d in docs)[r.doc_id] for r in found)


def test_bpe_cells_over_several_batches(spark):
    """Few words at a time, so that a task meets words again in later batches, and words that its tables grow for."""
    from tokenizers import Tokenizer

    rng, tokenizer = np.random.default_rng(3), Tokenizer.from_file(PATH)
    texts = [" ".join("".join(rng.choice(list("abcdefé日 "), int(rng.integers(1, 12)))) for _ in range(40)) for _ in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = bpe.encode_and_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), PATH, block_words=200).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(texts) and all(r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids and r.text == texts[r.doc_id] for r in found)




@pytest.mark.parametrize("words", [1, 1 << 20])
def test_sieves_of_any_filling_drop_the_same_rows(spark, clashing, monkeypatch, words):
    """A sieve so small that every row may be among those that go, and one that lets nearly all others pass."""
    from polyseq.llm import _shared

    monkeypatch.setattr(_shared, "SIEVE_WORDS", words)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of its own, number "), F.col("id") % 2000, F.lit(" of many with words "), F.col("id") % 2000).alias("text"))
    kept = exact_dedup.drop_copies(many, counters=4)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2000))
    gone = many.filter("doc_id % 3 = 0").select(F.xxhash64("doc_id").alias("h"))
    left = _shared.rows_without(many, F.xxhash64(many["doc_id"]), gone, "h")
    assert left.columns == many.columns and sorted(r.doc_id for r in left.collect()) == [k for k in range(3000) if k % 3]
    bench = spark.createDataFrame([(1, "number 7 of many with words 7")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(many, bench).collect()) == [k for k in range(3000) if k % 2000 != 7]
    held(exact_dedup.drop_copies(clashing, counters=4), clashing.columns)


def test_steps_leave_only_the_tables_that_their_result_reads(spark, clashing):
    from pathlib import Path

    from polyseq.llm._shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    bench = spark.createDataFrame([(7, "four five six seven")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, 1)], "doc_id long, quality int")
    for run, names in (
        (lambda: simhash.drop_similar(clashing), {"gone"}), (lambda: exact_dedup.drop_copies(clashing, counters=4), {"hot", "told"}),
        (lambda: decontaminate.drop_contaminated(clashing, bench), {"contaminated"}), (lambda: quality.keep_good(clashing, labels, sample=1000), set()),
    ):
        before = {p.name for p in folder.iterdir()}
        df = run()
        left = {p.name.removeprefix("polyseq-").rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before and p.name.startswith("polyseq-")}
        assert left == names
        df.collect()


def test_a_failing_step_closes_its_scratch(spark):
    from polyseq.llm import _shared

    with pytest.raises(ValueError), _shared.scratch(spark):
        raise ValueError
    assert not _shared._scratch


def test_languages_of_other_scripts_in_either_case(spark):
    """Cyrillic and Greek, learned in small letters and met in capitals."""
    rng = np.random.default_rng(6)
    pools = {"ru": "что это было для всех них потому ещё жизнь".split(), "bg": "какво това беше за всички тях защото още живот".split(), "el": "και αυτό ήταν για όλους επειδή ζωή λόγος".split()}
    rows = [(k, " ".join(rng.choice(pools[x], 25)), x) for k, x in enumerate(list(pools) * 150)]
    shouted = [(100_000 + k, t.upper(), None) for k, t, _ in rows[:90]]
    found = {r.doc_id: r for r in lang_id.identify(spark.createDataFrame(rows + shouted, "doc_id long, text string, lang string")).collect()}
    assert all(found[k].lang_pred == x for k, _, x in rows if found[k].held_out)
    assert all(found[100_000 + k].lang_pred == x for k, _, x in rows[:90])


def test_many_languages_and_a_dirty_column(spark):
    """A hundred and twenty languages are all learned; of more values than LANGS the rarest aren't."""
    rng = np.random.default_rng(9)
    pools = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60)) for _ in range(120)]
    words = [[p[k : k + 5] for k in range(0, 60, 5)] for p in pools]
    rows = [(k, " ".join(rng.choice(words[k % 120], 30)), f"l{k % 120:03d}") for k in range(120 * 60)]
    rows += [(50_000 + k, "zz yy", f"dirty{k}") for k in range(300)]
    found = lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out and doc_id < 50000").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 120:03d}" for r in found]) > 0.97 and len({r.lang_pred for r in found}) >= 120
