from collections import Counter

import pytest

import corpus_pipeline
from sorakana.llm import mixing, neardup, registry, toxicity

from . import brute
from .conftest import plain
from .test_toxicity import plain_score

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows(frame):
    return Counter(tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect())


def test_stages_against_plain_versions(spark, docs, folder, tmp_path):
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, given):
        out = stages[name](spark, given, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = stage("toxicity", docs)
    assert rows(clean) == Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in docs.collect() if plain_score(model, r["text"]) < 0.5)

    one = stage("minhash_neardup", clean)
    given = [(r["doc_id"], r["text"]) for r in clean.collect()]
    verdicts = brute.near_duplicates([i for i, _ in given], [t for _, t in given], 5)
    sets = brute.shingle_sets([t for _, t in given], 5)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = brute.components(len(sets), links)
    assert one.count() == len({g for g, s in zip(groups, sets, strict=True) if s}) + sum(not s for s in sets)
    kept = {i for i, _, _, k in verdicts if k}
    assert {r["doc_id"] for r in one.collect()} <= kept and not rows(one) - rows(clean)

    cut = stage("suffix_dedup", one)
    got = one.collect()
    want = Counter((r["doc_id"], x[4].decode("utf-8", "ignore")) for r, x in zip(got, brute.repeats([r["text"] for r in got]), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mix = stage("source_mixing", cut)
    sized = mixing.mix(cut).where("size > 0").collect()
    words = Counter()
    for r in mix.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert words == Counter({i: n for i, n in ((i, sum(r["taken"] for r in sized if r["doc_id"] == i)) for i in {r["doc_id"] for r in sized}) if n} | {i: 0 for i in words if not words[i]})

    packed = stages["best_fit_packing"](spark, mix, folder).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert (packed.piece == 0).sum() == mix.count()


def test_stages_do_not_depend_on_order_or_partitions(spark, docs, folder, tmp_path):
    """Each stage gives the same rows for its table in another order and other partitions."""
    given = {0: docs, 1: docs.repartition(7).sortWithinPartitions(docs["doc_id"].desc())}
    for name, stage in corpus_pipeline.STAGES:
        found = {}
        for k, frame in given.items():
            path = f"{tmp_path}/{name}-{k}"
            stage(spark, frame, folder).write.parquet(path)
            found[k] = spark.read.parquet(path)
            if k:
                found[k] = found[k].repartition(5)
        columns = [c for c in found[0].columns if c not in ("sequence_id", "offset")]
        assert Counter(tuple(r) for r in found[0].select(*columns).collect()) == Counter(tuple(r) for r in found[1].select(*columns).collect()), name
        given = found


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(spark, name):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    near = lambda f: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in plain(f)]
    assert near(registry.QUERIES[name](spark, SF).toPandas()) == near(c.execute(registry.ORACLES[name]).fetchdf())


def test_near_duplicates_in_stage_do_not_depend_on_ids_alone(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text), (5, text), (5, "another text of that id that is kept as it is"), (5, text)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.without_near_duplicates(frame).collect()) == [(1, text), (5, "another text of that id that is kept as it is")]


def test_queries_are_one_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op5_minhash_neardup", "op10_best_fit_packing", "op4_embedding_neardup"])
def test_queries_cover_whole_tables(spark, name):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    table = "embeddings" if "embedding" in name else "documents"
    key = "vec_id" if "embedding" in name else "doc_id"
    got = registry.QUERIES[name](spark, SF).select(key).distinct().count()
    assert got == spark.read.parquet(f"{SF}/{table}.parquet").count()
