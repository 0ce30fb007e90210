import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorakana.llm import embeddings, encoding, language, licenses, mixing, neardup, packing, quality, suffixes, tokens, toxicity
from sorakana.llm.graph import connected_components

from . import brute
from .conftest import plain


def ids_texts(docs):
    got = docs.select("doc_id", "text").collect()
    return [r[0] for r in got], [r[1] for r in got]


def test_near_duplicates_equal_brute_force(docs):
    ids, texts = ids_texts(docs)
    got = [tuple(r) for r in neardup.near_duplicates(docs, 4).collect()]
    assert Counter(got) == Counter(brute.near_duplicates(ids, texts))


def test_near_duplicates_of_five_words(docs):
    ids, texts = ids_texts(docs)
    got = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    assert Counter(got) == Counter(brute.near_duplicates(ids, texts, 5))


def test_borderline_cloud_in_blocks(spark, monkeypatch):
    """Copies that differ pairwise by about the threshold, in blocks smaller than their buckets."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.choice(80, 3, replace=False):
            w[at] = f"y{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = [tuple(r) for r in neardup.near_duplicates(frame, 4).collect()]
    assert Counter(got) == Counter(brute.near_duplicates(list(range(60)), texts))


def test_one_of_each_group_stays(docs):
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids, texts = ids_texts(kept)
    sets = [s for s in brute.shingle_sets(texts, 5) if s]
    assert len(set(sets)) == len(sets)
    assert set(brute.shingle_sets(ids_texts(docs)[1], 5)) >= set(sets)
    # Texts without words stay.
    assert sum(not s for s in brute.shingle_sets(texts, 4)) == sum(not s for s in brute.shingle_sets(ids_texts(docs)[1], 4))


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.9, 1.0):
        off = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            common = int(round(2 * 400 * share / (1 + share)))
            y = np.concatenate([x[:common], rng.integers(0, 1 << 63, 400 - common, dtype=np.uint64)])
            a, b = (np.frombuffer(neardup.signature(s)[1], np.uint8) for s in (x, y))
            off.append(neardup.estimate(np.array([np.bitwise_count(a ^ b).sum()]))[0] - common / (800 - common))
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.06


def test_repeats_equal_brute_force(docs):
    got = suffixes.remove_repeats(docs, keep=("doc_id",), texts=True).collect()
    ids, texts = ids_texts(docs)
    want = Counter((i, *x[:4], x[4].decode("utf-8", "ignore")) for i, x in zip(ids, brute.repeats(texts), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept_text"]) for r in got) == want


def test_repeats_across_pieces_and_batches(docs, monkeypatch):
    """Pieces that cut a text and many batches don't change the result."""
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    raw = np.frombuffer(("abc def ghi " * 3000).encode(), np.uint8)
    found = list(suffixes._pieces(raw, np.array([0, len(raw)])))
    covered = np.zeros(len(raw), int)
    for at, _, _, first, stop, _, _ in found:
        for a, b in zip(first, stop, strict=True):
            covered[at + a : at + b + 1] += 1
    assert (covered[: len(raw) - 199] == 1).all() and not covered[len(raw) - 199 :].any()


@pytest.mark.parametrize("name,kept", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(docs, name, kept):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ids_texts(docs)[1] + ["it's they'll  x", "a\n\n b\n", " x", "x ", " y z　w", "Σας́ é.!?;", "a\x00b c", "a,b, c.d 12.5"]
    definition = encoding.tokenizer_json(name)
    ids, bounds = encoding.Encoder(definition, kept)(pa.array(texts, pa.string()))
    plain_ids = Tokenizer.from_str(definition).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids + [2] for e in plain_ids]


def test_repeats_of_many_equal_rows(spark):
    rng = np.random.default_rng(14)
    own = ["".join(rng.choice(list("abcdef "), 700)) for _ in range(4)]
    texts = [own[0]] * 40 + [own[1]] * 3 + [own[2]] * 2 + [own[3], own[0][100:450] + "tail", None, None, None, "short", "short", "short"]
    ids = [None] * 40 + [1] * 3 + [2] * 2 + [3, 4, 5, 5, 5, 6, 6, 6]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in suffixes.remove_repeats(frame, texts=True).collect())
    assert got == Counter((i, *x[:4], x[4].decode()) for i, x in zip(ids, brute.repeats(texts), strict=True))


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    definition = encoding.tokenizer_json("word_bpe_49k.json")
    path = str(tmp_path / "ids")
    tokens.write_token_files(docs, path, definition)
    t = Tokenizer.from_str(definition)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in zip(*ids_texts(docs), strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.read_token_files(spark, path).collect()) == want
    rows = tokens.token_digests(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    numbers = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert numbers == sorted(numbers)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == Counter({(i, zlib.crc32(np.array(ids, "<u4").tobytes())): n for (i, ids), n in want.items()})


def test_cuts_of_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    definition = encoding.tokenizer_json("byte_bpe_50k.json")
    texts = ["one two six", "six two one ten", "ten six three eleven", ""]
    plain_ids = [Tokenizer.from_str(definition).encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for mask in (0, 1, 3):
        e = encoding.Encoder(definition, True)
        ranges = e.hashes.ranges
        monkeypatch.setattr(e.hashes, "ranges", lambda *a, r=ranges, m=mask: r(*a) & np.uint64(m))
        for _ in range(2):
            ids, bounds = e(__import__("pyarrow").array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == plain_ids


FAR = 5_000_000_000  # beyond 32 bits, so that it reaches the JVM as a long


def test_token_files_have_indexes(spark, tmp_path):
    """Ids are in the second run-length encoding; by row index and Bloom filters a lookup reads a few rows of a file."""
    path = str(tmp_path / "ids")
    frame = spark.range(20_000).select((F.col("id") * 2 + FAR).alias("doc_id"), F.repeat(F.lit("a word "), (F.col("id") % 30).cast("int")).alias("text"))
    tokens.write_token_files(frame.coalesce(1), path, encoding.tokenizer_json("word_bpe_49k.json"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
    kinds = jvm.java.lang.Class.forName("org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf$Type").getEnumConstants()
    integers = next(k for k in kinds if k.toString() == "LONG")
    fields = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
    fields[0] = "doc_id"

    def read(reader, doc_id):
        found = sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", integers, doc_id).end().build()
        rows, batch, n = reader.rows(reader.options().searchArgument(found, fields)), reader.getSchema().createRowBatch(), 0
        while rows.nextBatch(batch):
            n += batch.count()
        return n

    total = there = other = 0
    for file in tmp_path.glob("ids/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        total += reader.getNumberOfRows()
        there, other = there + read(reader, FAR + 7000), other + read(reader, FAR + 7001)
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kind = [footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())]
            assert kind[2:] == ["DIRECT_V2"] * 5  # doc_id, first, n_tokens, ids and its elements
            streams = [(x.getKind().toString(), x.getColumn()) for x in (footer.getStreams(i) for i in range(footer.getStreamsCount()))]
            assert ("BLOOM_FILTER_UTF8", 2) in streams and ("ROW_INDEX", 2) in streams
    assert total == 20_000 and 1 <= there <= 2000 and other <= 1000


def test_packing(docs):
    from tokenizers import Tokenizer

    definition = encoding.tokenizer_json("byte_bpe_50k.json")
    got = packing.pack_documents(docs, definition, 128).toPandas()
    t = Tokenizer.from_str(definition)
    want = Counter()
    for i, x in zip(*ids_texts(docs), strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        head = len(ids) - (-(-len(ids) // 128) - 1) * 128
        cuts = [0, *range(head, len(ids) + 1, 128)] if len(ids) > 128 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((None if r[0] != r[0] else r[0], *r[1:]) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).itertuples(index=False)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 128
        assert (own.offset == own.length.cumsum() - own.length).all()
    assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / 128) * 1.03 + 1


def _pieces(spark, sizes, partitions):
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long")
    return frame.repartitionByRange(partitions, "doc_id") if partitions else frame.coalesce(1)


@pytest.mark.parametrize("partitions", [0, 64])
def test_packing_of_sorted_tables(spark, partitions):
    """Long pieces first, then short ones, as in a table sorted by source, in many partitions or in one."""
    rng = np.random.default_rng(12)
    sizes = np.concatenate([rng.integers(530, 1000, 8000), rng.integers(1, 300, 8000)])
    got = packing.pack(_pieces(spark, sizes, partitions), per_task=1000).toPandas()
    assert sorted(got.doc_id) == list(range(len(sizes)))
    own = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert own.length.sum().max() <= 1024 and (got.sort_values(["sequence_id", "offset"]).offset == own.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length).all()
    assert got.sequence_id.nunique() <= 8000 * 1.01


def test_packing_sends_little_up(spark, monkeypatch):
    """Rounds after the first read a few bins of each task, and join what is left over."""
    rounds, plain_store = [], packing.store
    monkeypatch.setattr(packing, "store", lambda df, name: rounds.append(plain_store(df, name)) or rounds[-1])
    sizes = np.append(np.random.default_rng(13).integers(1, 700, 11_990), [1024] * 10)
    got = packing.pack(_pieces(spark, sizes, 16), per_task=200).toPandas()
    assert got.sequence_id.nunique() <= np.ceil(sizes.sum() / 1024) * 1.02 + 1
    made, sent = ([f.where(c).count() for f in rounds] for c in ("true", "open"))
    assert len(rounds) == 3 and sent[-1] == 0
    assert all(s <= (packing.FAN_IN + 1) * w for s, w in zip(sent, (60, 8, 1), strict=True)) and sum(made[1:]) < sum(sent)


def test_best_fit_is_tight():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 700, 3000)
    where = packing.best_fit(sizes, 1024)
    used = np.bincount(where, weights=sizes)
    assert used.max() <= 1024 and len(used) <= np.ceil(sizes.sum() / 1024) * 1.02


def test_mixing_equals_sql(docs, duck):
    got = mixing.mix(docs).toPandas()
    want = duck.execute(mixing.ORACLE).fetchdf()
    near = lambda f: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in plain(f)]
    assert near(got) == near(want)
    by = got.assign(t=got.target.round(6)).groupby("t").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (got.taken <= 2 * got["size"]).all()


def test_mixing_reaches_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).toPandas().merge(frame.select("doc_id", "source").toPandas(), on="doc_id")
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    again = mixing.mix(frame.repartition(5)).toPandas()
    assert plain(again) == plain(got.drop(columns="source"))
    copies = mixing.mixed(frame).groupBy("doc_id").agg(F.count("*").alias("n")).toPandas()
    merged = got.merge(copies, on="doc_id", how="left").fillna({"n": 0})
    assert (merged.taken == merged["size"] * merged.n).all()


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # 3090 words: a (5) and null (5) stop at 20 and 100, b (2) at 2000; c (1) has the rest.
    assert got == {"a": 20.0, None: 100.0, "b": pytest.approx(1980.0), "c": pytest.approx(990.0)}


def test_quality_equals_sql(docs, duck):
    assert plain(quality.filter_quality(docs).toPandas()) == plain(duck.execute(quality.ORACLE).fetchdf())


def test_junk_does_not_widen_its_own_fences(spark):
    """Groups with 30 to 50 % junk lose it and nothing else; a source of another kind keeps its own fences."""
    rng = np.random.default_rng(9)
    rows = []
    add = lambda lang, source, junk, marks: rows.append((len(rows), " ".join(f"w{x}{'#' * marks}" for x in rng.integers(1000, 9000, 80)), lang, source, junk))
    for lang in ("en", "fr"):
        for k in range(6):
            for _ in range(100):
                add(lang, f"s{k}", False, 0)
    for lang, share in (("en", 30), ("en", 40), ("en", 50), ("alone", 40)):
        for i in range(100):
            add(lang, f"junk{share}", i < share, 3 * (i < share))
    for _ in range(60):
        add("en", "marked", False, 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = {r["doc_id"]: r["kept"] for r in quality.filter_quality(frame).collect()}
    assert [r[0] for r in rows if r[4] and got[r[0]]] == []
    assert [r[2:4] for r in rows if not r[4] and not got[r[0]]] == []


def test_fences_follow_the_habits_of_groups(spark):
    """Groups that differ in how much they mark, repeat lines and passages get fences that differ as much."""
    rng = np.random.default_rng(10)
    rows = []
    for source, habit in (("plain", 1), ("rich", 4)):
        for _ in range(200):
            lines = [" ".join(f"{''.join(rng.choice(list('abcdefgh'), rng.integers(3, 8)))}" for _ in range(8)) for _ in range(20)]
            lines[3] += " " + "#" * int(rng.integers(2, 6) * habit)
            lines += lines[5 : 5 + int(rng.integers(1, 3) * habit)]
            rows.append((len(rows), "\n".join(lines), "en", source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from sorakana.llm.common import store

    found = {r["t_source"]: r for r in quality.thresholds(store(quality.counts(frame), "counts")).collect()}
    for m in ("symbols", "dup_lines", "repeats"):
        assert found["rich"][f"{m}_high"] > 1.2 * found["plain"][f"{m}_high"] > 0
    assert quality.filter_quality(frame).where("kept").count() == len(rows)


def test_a_gap_has_the_fence_inside(spark):
    """A few documents full of marks, where others have few or none, go in every group; those with few stay."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(4):
        for i in range(120):
            marks = 60 + 20 * k if i < 12 else 0
            rows.append((len(rows), " ".join(f"{''.join(rng.choice(list('abcdefgh'), rng.integers(3, 8)))}" for _ in range(100)) + "#" * marks, "en", f"s{k}", marks > 0))
    got = {r["doc_id"]: r["kept"] for r in quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")).collect()}
    assert all(got[r[0]] != r[4] for r in rows)


def test_licenses_equal_sql(spark, docs, duck, tmp_path):
    assert plain(licenses.scan(docs).toPandas()) == plain(duck.execute(licenses.ORACLE).fetchdf())
    mit = "Copyright (c) 2020 Some One\n\n" + licenses.TEXTS["MIT"].replace("sublicense", "sub-licence").upper()
    frame = spark.createDataFrame([(1, mit), (2, "x\nReleased under the MIT Licence.\nLicensed under the Apache License, version 2.0"), (3, licenses.TEXTS["MIT"] + " and more")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["n_license_lines"], r["line_licenses"]) for r in licenses.scan(frame).collect()}
    assert got == {1: ("MIT", 1, "MIT"), 2: (None, 2, "Apache-2.0,MIT"), 3: (None, 0, "")}


def test_standard_license_files(spark):
    """Files of each known text with and without titles and in usual line breaks, and notices of the GNU licences."""
    import os
    import re
    import textwrap

    rows, want = [], []
    for lic in sorted(x.removesuffix(".txt") for x in os.listdir(licenses.FOLDER)):
        with open(os.path.join(licenses.FOLDER, lic + ".txt"), encoding="utf-8") as f:
            text = f.read()
        bodies = [text] + ([f"{licenses.TITLES[lic][0]}\n\nCopyright (c) 2020 Some One\n\n{text}", "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in text.split("\n\n"))] if lic in licenses.TITLES and lic != "Unlicense" else [])
        rows += bodies
        want += [(lic, None)] * len(bodies)
    for lic, text in [(w[0], t) for w, t in zip(want, rows, strict=True) if w[0] != "MPL-1.1"]:  # its notice at the end has blanks for holders
        for width in range(50, 101, 1 if len(text) < 15_000 else 10):
            wrapped = lambda p: p if re.search(r"(?mi)^\W*copyright (\(c\)|[0-9]{4})", p) else textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False)  # noqa: B023, E731
            rows.append("\n\n".join(wrapped(p) for p in text.split("\n\n")))
            want.append((lic, None))
    rows[want.index(("Apache-2.0", None))] = rows[want.index(("Apache-2.0", None))].split("   APPENDIX")[0]  # as often shipped
    for line, lic in (("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("Licensed under the GNU General Public License v3.0", "GPL-3.0"), ("License: AGPL-3.0-only", "AGPL-3.0"), ("Released under the GNU GPLv2 or later.", "GPL-2.0")):
        rows.append("some text\n" + line)
        want.append((None, lic))
    assert {w[0] for w in want if w[0]} >= {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0", "Zlib", "BSL-1.0", "MIT-0", "Artistic-1.0-Perl", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "LGPL-2.0", "MPL-1.1"}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [(got[i]["license"], None if w[1] is None else got[i]["line_licenses"]) for i, w in enumerate(want)] == want


def vectors(rng):
    rows = []
    for label in (0, 1):
        x = rng.normal(size=(150, 24))
        near = x[:30] + rng.normal(size=(30, 24)) * 0.12
        for v in (*x, *near, x[0], x[0], 3 * x[1]):
            rows.append(([float(a) for a in v], label))
    cloud = rng.normal(size=24) + rng.normal(size=(300, 24)) * 0.2
    rows += [([float(a) for a in v], 2) for v in cloud]
    rows += [(None, 0), ([0.0] * 24, 0), ([float("nan")] * 24, 0), ([None] * 24, 0), ([float("inf")] + [1.0] * 23, 0), ([], 0), (rows[0][0], None), ([1.0, 2.0], 0), ([1e300, 1e300], 0), ([1e-300, 1e-300], 0)]
    return [(i if i != 5 else None, v, label, "x") for i, (v, label) in enumerate(rows)]


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rows = vectors(np.random.default_rng(4))
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")).toPandas()
    links, good = [], {}
    for k, (_, v, label, _) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[k] = (label, x / np.linalg.norm(x))
    for i in good:
        for j in good:
            if j < i and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.93:
                links.append((i, j))
    found = got.n_links.sum() / 2
    assert 0.98 * len(links) <= found <= len(links)
    comp = brute.least_ids([r[0] for r in rows], brute.components(len(rows), links))
    want = {r[0]: c for r, c in zip(rows, comp, strict=True)}
    have = {None if a != a else int(a): None if c != c else int(c) for a, c in zip(got.vec_id, got.component_id, strict=True)}
    assert sum(have[i] == want[i] for i in want) >= 0.98 * len(want)
    assert len(got) == len(rows)


def test_language_learns(spark):
    rng = np.random.default_rng(2)
    kinds = {"aa": ["the", "thing", "ing", "tion", "other"], "bb": ["le", "eau", "que", "ment", "aux"], "cc": ["der", "ung", "sch", "ein", "keit"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 2)) for _ in range(rng.integers(3, 40))), k) for i, k in enumerate(rng.choice(list(kinds), 900))]
    rows += [(2000, None, "aa"), (2001, "", "aa"), (2002, "12 34 !!", None), (None, "thething other", "aa"), (2003, "thing " * 30000, "aa")]
    frame = spark.createDataFrame([(i, t, str(k) if k else None, "z") for i, t, k in rows], "doc_id long, text string, lang string, score string")
    got = language.identify(frame, language.train(frame, rows=400)).toPandas().merge(frame.select("doc_id", "text", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.text.str.len().gt(0)]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert set(got[got.doc_id.isin([2000, 2001, 2002])].lang_pred) == {"und"}
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {*kinds, "und"}


def _plain_language(model, text):
    """The probabilities of a text by one gram at a time."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    total, count = np.zeros(len(model.languages)), 0
    for n in (2, 3, 4):
        for i in range(len(low) - n + 1):
            h = n
            for c in low[i : i + n]:
                h = (h * 256 + c) % 2**64
            for _ in range(2):
                h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) % 2**64
            h ^= h >> 32
            total += model.shares[:, h >> 49]
            count += 1
    z = (total / max(count, 1) + model.bias * (count > 0)) * model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_language_equals_a_plain_softmax(spark, monkeypatch):
    rng = np.random.default_rng(3)
    kinds = {"aa": "thing", "bb": "eaux", "cc": "schen"}
    make = lambda k, n: "".join(rng.choice(list(kinds[k] + "AZ .é"), n))
    rows = [(i, make(k, 40 + i % 60), k) for i, k in enumerate(rng.choice(list(kinds), 300))]
    model = language.fit([t for _, t, _ in rows], [str(k) for _, _, k in rows])
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows[:60]] + [(900, "a"), (901, make("aa", 5000))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(frame, model).collect()}
    for i, text in ((r["doc_id"], r["text"]) for r in frame.collect()):
        p = _plain_language(model, text)
        assert got[i]["lang_pred"] == model.languages[p.argmax()] and got[i]["score"] == pytest.approx(p.max(), abs=1e-6)
        assert got[i]["accepted"] == (got[i]["score"] >= model.least)
    import pyarrow as pa

    from sorakana.llm.common import text_bytes

    texts = text_bytes(pa.array([t for _, t, _ in rows]))
    whole = model.probabilities(*texts)
    monkeypatch.setattr(language, "CHUNK", 97)
    assert np.allclose(model.probabilities(*texts), whole)


def test_accepted_answers_reach_their_precision(spark):
    """On rows that neither training nor calibration has seen, with texts of two languages mixed."""
    rng = np.random.default_rng(4)
    kinds = {"aa": ["the", "thing", "ing"], "bb": ["ter", "then", "ang"], "cc": ["der", "ung", "sch"]}
    rows = []
    for i, k in enumerate(rng.choice(list(kinds), 1500)):
        other = kinds[str(rng.choice(list(kinds)))]
        rows.append((i, " ".join("".join(rng.choice(kinds[k] if rng.random() < 0.8 else other, 2)) for _ in range(rng.integers(3, 15))), str(k)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(frame, language.train(frame, rows=3000)).toPandas().merge(frame.toPandas(), on="doc_id")
    held = got[got.held_out]
    right = held.lang_pred == held.lang
    assert right.mean() < 0.99 and 0.1 < held.accepted.mean() < 1
    assert right[held.accepted].mean() >= 0.97


def test_languages_of_long_texts_only(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice(["the", "ing"], 2)) for _ in range(30)), "aa") for i in range(60)]
    rows += [(100 + i, " ".join("".join(rng.choice(["der", "ung"], 2)) for _ in range(9000)), "bb") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(frame, language.train(frame)).toPandas()
    assert (got.lang_pred == ["aa"] * 60 + ["bb"] * 12).mean() > 0.98


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(200)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    comp = brute.components(len(nodes), [(at[a], at[b]) for a, b in real])
    assert got == {n: nodes[c] for n, c in zip(nodes, comp, strict=True)}


def test_empty_tables(spark, nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.without_near_duplicates(nothing).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0
    assert quality.filter_quality(nothing).count() == 0
    assert licenses.scan(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert language.identify(nothing, language.train(nothing)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert packing.pack_documents(nothing, encoding.tokenizer_json("byte_bpe_50k.json")).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_empty_token_files(spark, nothing, tmp_path):
    tokens.write_token_files(nothing, str(tmp_path / "ids"), encoding.tokenizer_json("word_bpe_49k.json"))
    assert tokens.token_digests(spark, str(tmp_path / "ids")).count() == 0


def test_language_on_odd_rows(docs):
    got = language.identify(docs, language.train(docs)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
