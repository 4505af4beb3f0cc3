"""The stored index, and candidates with common terms held back."""

import random

import pytest
from pyspark.sql import functions as F

from sonarium.operators import index as ix
from sonarium.operators import search as se


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_batches_keep_a_flat_plan_and_prune_buckets(spark):
    index = ix.new_index(spark, buckets=16)
    want, plans = {}, []
    rng = random.Random(1)
    for batch in range(10):
        rows = [(i, [rng.randrange(1 << 20) << 4 for _ in range(6)] if rng.random() < 0.8 else None) for i in rng.sample(range(60), 15)]
        index = index.updated(spark.createDataFrame(rows, "id long, hashes array<int>"), {"batch": batch})
        want |= dict(rows)
        plans.append(plan(index.terms).count("Scan parquet"))
    terms = sorted((i, t) for i, h in want.items() if h for t in set(h))
    assert sorted(map(tuple, index.terms.collect())) == terms
    assert plans[-1] == plans[1] <= 2 * 2  # the postings and the tombstones, named in the tree and below it
    some = terms[0][1]
    asked = spark.createDataFrame([(some,)], "term long")
    found = index.holding(asked)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # with it the scan prunes as well, but does not say so
    spark.conf.set(auto, "false")
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan(index.holding(asked))
    finally:
        spark.conf.unset(auto)
    assert index.postings([some]).rdd.getNumPartitions() < index.postings().rdd.getNumPartitions()
    assert sorted(map(tuple, found.collect())) == [x for x in terms if x[1] == some]
    again = ix.open_index(spark, index.folder)
    assert again == index and again.info() == {"documents": sum(bool(h) for h in want.values()), "terms": len(terms), "batch": 9}
    small = index.compacted()
    assert sorted(map(tuple, small.terms.collect())) == terms == sorted(map(tuple, index.terms.collect()))
    assert "dead" not in plan(small.terms)
    with pytest.raises(ix.Conflict):
        index.updated(spark.createDataFrame([(1, [16])], "id long, hashes array<int>"))
    assert sorted(map(tuple, ix.open_index(spark, index.folder).terms.collect())) == terms  # the late writer's rows do not count
    ix.remove_index(small)


def plain_candidates(queries, corpus, most, percent):
    out = set()
    for q, asked in queries.items():
        counts = sorted((-len(asked & held), i) for i, held in corpus.items() if asked & held)[:most]
        out |= {(q, i, -n) for n, i in counts if -n * 100 > -counts[0][0] * percent}
    return out


@pytest.mark.parametrize("most,percent", [(20, 10), (3, 40), (5, 0)])
def test_common_terms_are_held_back_without_loss(spark, most, percent):
    rng = random.Random(most)
    every = [16 * i for i in range(8)]  # terms of nearly all documents
    corpus = {i: set(rng.sample(range(1000, 1200), 12)) | {t for t in every if rng.random() < 0.9} for i in range(400)}
    queries = {q: set(rng.sample(sorted(corpus[q * 7]), 10)) | set(rng.sample(every, 5)) for q in range(30)} | {90: set(every), 91: {5}, 92: {0, 1001}}
    rows = lambda held, name: spark.createDataFrame([(k, t) for k, v in held.items() for t in v], f"{name} long, term long")
    want = plain_candidates(queries, corpus, most, percent)
    for common in (0, 30, 200, 1000):
        got = se.candidates(rows(queries, "query_id"), rows(corpus, "id"), most=most, least_percent=percent, common=common)
        assert {tuple(r) for r in got.collect()} == want


def test_a_term_of_all_documents_joins_few_rows(spark, monkeypatch):
    """One term is in every document: rows that meet by terms, with it held back and without."""
    n, asked = 3000, 40
    corpus = spark.range(n).select("id", F.explode(F.array(F.lit(0), *[F.col("id") * 4 + 10 + i for i in range(4)])).alias("term"))
    queries = corpus.where(F.col("id") < asked).select(F.col("id").alias("query_id"), "term")
    joined = []
    keep = se.Scratch.keep

    def counting(self, df, name="step", outlive=False):
        out = keep(self, df, name, outlive)
        if name == "counts":
            joined.append(out.agg(F.sum("matches")).first()[0])
        return out

    monkeypatch.setattr(se.Scratch, "keep", counting)
    got = se.candidates(queries, corpus, most=1, least_percent=40, common=100)
    assert {tuple(r) for r in got.collect()} == {(i, i, 5) for i in range(asked)}
    everything = queries.join(corpus, "term").count()
    assert sum(joined) * 10 < everything


def test_what_shares_a_term_never_becomes_a_row(spark, monkeypatch):
    """Every document shares a term with every query: of each query some rows for each shard are ranked, however many documents there are."""
    n, asked = 2000, 20
    corpus = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(16), F.col("id") * 16 + 32)).alias("term"))
    queries = corpus.where(F.col("id") < asked).select(F.col("id").alias("query_id"), "term")
    monkeypatch.setattr(se, "LEAST_SHARD", 1500)
    monkeypatch.setattr(se, "BLOCK", 30)
    ranked = []
    inner = se._ranked
    monkeypatch.setattr(se, "_ranked", lambda counted, *a: (ranked.append(counted.count()), inner(counted, *a))[1])
    for common in (0, 5000):
        got = {tuple(r) for r in se.candidates(queries, corpus, most=3, common=common).collect()}
        assert got == {(q, k, 3 if q == k else 2) for q in range(asked) for k in sorted({q, *[k for k in range(4) if k != q][:2]})}
    assert max(ranked) <= asked * 3 * 4


@pytest.mark.parametrize("common", [0, 30, 5000])
def test_queries_travel_to_groups_and_not_to_shards(spark, monkeypatch, common):
    """With many more shards than cores a query still has some rows for each group of shards, and goes to each group once; counts are the same."""
    rng = random.Random(5)
    corpus = {i * 3: {rng.choice((rng.randrange(40), rng.randrange(4000))) << 4 for _ in range(25)} for i in range(300)}
    queries = {q: set(rng.sample(sorted(corpus[q * 30]), 12)) for q in range(25)}
    rows = lambda held, name: spark.createDataFrame([(k, t) for k, v in held.items() for t in v], f"{name} long, term long")
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(se, "SHARD", 150)
    sent, ranked = [], []
    inner, packed = se._ranked, getattr(se, "packed", None)
    monkeypatch.setattr(se, "_ranked", lambda counted, *a: (ranked.append(counted.count()), inner(counted, *a))[1])
    monkeypatch.setattr(se, "packed", lambda df: (sent.append(df.count()), packed(df))[1], raising=False)
    got = {tuple(r) for r in se.candidates(rows(queries, "query_id"), rows(corpus, "id"), most=4, least_percent=0, common=common).collect()}
    assert got == plain_candidates(queries, corpus, 4, 0)
    assert max(ranked) <= len(queries) * 4 * cores < len(queries) * 4 * 10
    assert sent == [sum(map(len, queries.values())), sum(len(v & set().union(*queries.values())) for v in corpus.values())]


def test_postings_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(ix, "PACKED", 7)
    docs = [(1, [5, -3, 2**31 - 1, 5]), (2, []), (3, None), (4, [None, 7]), (-9, list(range(30))), (None, [1])]
    lists = spark.createDataFrame(docs, "id long, terms array<long>")
    parts = lists.select(F.transform("terms", lambda x: F.pmod(x, F.lit(3)).cast("int")), "id", "terms")
    want = sorted((t % 3, k, t) for k, v in docs for t in v or () if k is not None and t is not None)
    for rows in (parts, lists.select("id", F.explode("terms").alias("t")).select(F.pmod("t", F.lit(3)), "id", "t")):
        held = ix.packed(rows)
        assert held.count() < len(want) and held.agg(F.sum("n")).first()[0] == len(want)
        batches = held.select("part", "n", "keys", "terms").orderBy("part").toArrow().to_batches()
        assert sorted((at[0], int(k), int(t)) for at, keys, terms in ix.unpacked(iter(batches), ["part"]) for k, t in zip(keys, terms, strict=True)) == want


def test_hashes_of_far_documents_do_not_travel(spark):
    base = [i * 16 for i in range(200)]
    rows = [(i, base, 100, i) for i in range(1, 5)] + [(i, [x + 1_000_000 * i for x in base], 100, i) for i in range(5, 40)]
    corpus = spark.createDataFrame(rows, "id long, hashes array<int>, length int, group long")
    asked = spark.createDataFrame([(1, base, 100)], "query_id long, hashes array<int>, length int")
    want = sorted(map(tuple, se.search(asked, corpus).collect()))
    with se.Scratch(spark) as scratch:
        found = se.search(asked, corpus, scratch=scratch)
        assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want and len(want) == 4


def test_shards_count_only_earlier_ones(spark):
    rows = [(i, t) for i in range(50) for t in (0, 16 * (i % 5) + 16)]
    corpus = spark.createDataFrame(rows, "id long, term long")
    got = {tuple(r) for r in se.candidates(corpus.withColumnRenamed("id", "query_id"), corpus, most=50, least_percent=0, earlier=True).collect()}
    assert got == {(q, k, 1 + (q % 5 == k % 5)) for q in range(50) for k in range(q)}


def test_the_limit_is_on_fingerprints(spark):
    """Twelve near copies on one track fill the ten results; the other track does not come out."""
    base = [i * 16 for i in range(200)]
    rows = [(i, base, 100, 1) for i in range(1, 13)] + [(13, base, 100, 2)]
    corpus = spark.createDataFrame(rows, "id long, hashes array<int>, length int, group long")
    asked = spark.createDataFrame([(1, base, 100)], "query_id long, hashes array<int>, length int")
    assert [(r.id, r.group, r["rank"]) for r in se.search(asked, corpus).collect()] == [(1, 1, 1)]
    assert len(se.search(asked, corpus, limit=13).collect()) == 2


def test_stored_results_have_a_length_band(spark):
    corpus = spark.createDataFrame([(1, 100, 1), (2, 108, 2), (3, 93, 3)], "id long, length int, group long")
    results = spark.createDataFrame([(9, i, 0.9) for i in (1, 2, 3)], "query_id long, id long, score double")
    asked = spark.createDataFrame([(9, 100)], "query_id long, length int")
    assert sorted(r.id for r in se.search_stored(results, asked, corpus).collect()) == [1, 3]
    assert se.search_stored(results, asked, corpus, length_band=None).count() == 3


def test_large_batches_are_written_by_many_tasks(spark, monkeypatch):
    """A bucket has several files, each of one task, and no limit gathers the hashes of a growing index."""
    corpus = spark.range(1, 101).select("id", F.array(*[(F.col("id") * 100 + i * 16).cast("int") for i in range(5)]).alias("hashes"))
    monkeypatch.setattr(ix, "PER_FILE", 5)
    inner, plans = ix.term_index, []
    monkeypatch.setattr(ix, "term_index", lambda rows, *a, **b: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), inner(rows, *a, **b))[1])
    index = ix.new_index(spark, buckets=2).grown(corpus, 60)
    assert index.attribute(ix.NEWEST) == 60 and index.grown(corpus, 0) == index
    files = {r.f for r in index.postings().select(F.input_file_name().alias("f")).distinct().collect()}
    assert 8 <= len(files) <= 12
    index = index.grown(corpus, 1000)
    assert sorted(r.id for r in index.terms.select("id").distinct().collect()) == list(range(1, 101))
    assert all("Limit" not in p for p in plans)
    ix.remove_index(index)


def test_files_are_sorted_without_comparing_buckets(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, [rng.randrange(1 << 31) for _ in range(40)]) for i in range(300)], "id long, hashes array<int>")
    index = ix.new_index(spark, buckets=4).updated(docs)
    files = {}
    for r in index.postings().select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), "term", F.expr("pmod(hash(term), 4)").alias("b")).collect():
        files.setdefault(r.f, []).append((r.n, r.term, r.b))
    assert len(files) == 4
    for rows in files.values():
        terms = [t for _, t, _ in sorted(rows)]
        assert terms == sorted(terms) and len({b for *_, b in rows}) == 1
    # Sorted by the writer itself, rows would be compared by bucket and key.
    assert "Sort Columns" not in {r.col_name for r in spark.sql(f"DESCRIBE FORMATTED {index._postings()}").where("data_type != '[]'").collect()}
    assert spark.conf.get(ix.OPEN_FILES) == "0"
    ix.remove_index(index)


def test_an_empty_index_asks_for_no_terms(spark):
    asked = spark.range(3).select(F.col("id").alias("query_id"), F.raise_error(F.lit("worked out")).cast("long").alias("term"))
    full = se.candidates(spark.createDataFrame([(1, 16)], "query_id long, term long"), spark.createDataFrame([(5, 16)], "key int, term long"), key="key")
    none = se.candidates(asked, spark.createDataFrame([], "key int, term long"), key="key")
    assert none.collect() == [] and none.dtypes == full.dtypes and [tuple(r) for r in full.collect()] == [(1, 5, 1)]
    index = ix.new_index(spark, buckets=2)
    assert se.candidates(asked, index).collect() == []
    ix.remove_index(index)
