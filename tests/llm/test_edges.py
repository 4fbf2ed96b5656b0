"""Odd rows, names and lengths, by value, for every operator and stage."""

from __future__ import annotations

import collections
import hashlib
import math

import pytest

from tidemark.llm import ann, bpe, common, exact_dedup, langid, mixing, near_dedup, quality, secret_scan, token_counts, toxicity

SF = "/root/testdata/sf0.001"
#: Names that meet those of work columns, have dots, blanks and quotes, or are those of results.
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__tm_id", "__tm_sha", "__tm_row", "__tm_hash", "__tm_words", "kept", "score", "blob", "odd `name", "taken"]
LONG = "Slow rivers carry silt to the sea and leave it there, year after year. " * 14_000  # a megabyte


@pytest.fixture(scope="module")
def rows():
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    return [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "a b"), (5, "a b"), (None, "x y z w"), (None, None), (7, near), (8, near + " more"), (9, LONG), (10, "password=abcd1234 you"), (11, LONG + "end")]


@pytest.fixture(scope="module")
def df(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES[5:])
    return spark.createDataFrame([(i, t, "en", "s" if (i or 0) % 2 else None, None, *["e"] * len(NAMES[5:])) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (8, 1, 3)], "doc_id long, quality int, toxic int")


def key(r):
    return tuple((v is None, str(v)) for v in r)


def whole(df):
    return collections.Counter((r[0], r[1], *r[5:]) for r in df.collect())


def test_exact_dedup(df, rows):
    got = {t for (_, t, *rest) in whole(exact_dedup.exact_dedup(df)) if set(rest) == {"e"}}
    left = exact_dedup.exact_dedup(df)
    assert left.columns == NAMES
    assert sorted(key(r[:2]) for r in left.collect()) == sorted(key(r) for r in [(2, ""), (3, "  \n"), (5, "a b"), (None, "x y z w"), *rows[8:]])
    assert len(got) == 9
    digest = {r.doc_id: r for r in exact_dedup.exact_groups(df).collect()}
    assert digest[9].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and (digest[4].keep_id, digest[4].group_size, digest[4].kept) == (5, 3, False)
    assert (digest[1].keep_id, digest[1].group_size) == (2, 3)


def test_near_dedup(df, rows):
    left = near_dedup.near_dedup(df)
    assert left.columns == NAMES
    want = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (None, "x y z w"), (None, None), (7, rows[8][1]), (9, LONG), (10, rows[11][1])]
    assert sorted(key(r[:2]) for r in left.collect()) == sorted(map(key, want))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect() if r.doc_id}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[5] == (1, 4) and got[8] == (15, 7) and got[11][1] == 9


def test_rows_without_id_that_are_all_alike(spark):
    """A third of the table has neither id nor another text: work stays in proportion, one row stays."""
    text = " ".join(f"w{n}" for n in range(40))
    many = spark.createDataFrame([(None, text)] * 3000 + [(n, " ".join(f"v{n}x{k}" for k in range(30))) for n in range(200)] + [(None, text + " more")], "doc_id long, text string")
    got = collections.Counter((r.doc_id is None) for r in near_dedup.near_dedup(many).collect())
    assert got == {True: 1, False: 200}


def test_mixing(df, rows):
    got = {(r.doc_id, r.source): r for r in mixing.mix(df).collect()}
    words = lambda t: len((t or "").split())
    assert all(r.size == words(dict(rows)[i]) or i is None for (i, _), r in got.items()) and all(0 <= r.taken <= 2 * r.size for r in got.values())
    out = mixing.mixed_documents(df)
    assert out.columns == NAMES and sum(words(r.text) for r in out.collect()) == sum(r.taken for r in mixing.mix(df).collect())
    assert all(r["a.b"] == "e" and r["__tm_words"] == "e" and r.n_chars == len(r.text) for r in out.collect())


def test_bpe(df, rows):
    own = bpe.load(bpe.default_vocabulary())
    want = [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()) for i, t in rows for ids in own.encode_batch([t or ""])]
    assert sorted(map(key, bpe.encode_digests(df).collect())) == sorted(map(key, want))


def test_secrets(df, rows):
    want = [(i, secret_scan._shown(secret_scan.find(t or ""))) for i, t in rows]
    assert sorted(key((r.doc_id, r.spans)) for r in secret_scan.scan(df).collect()) == sorted(map(key, want))
    assert any(s for _, s in want)


def test_toxicity(df, labels):
    got = toxicity.score(df, labels).collect()
    assert len(got) == 13 and all(r.predicted == 0 and 0 <= r.score < 0.7 for r in got)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == NAMES and whole(kept) == whole(df)
    assert {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {toxicity.NO_HIT}


def test_quality(df, rows):
    got = quality.classify(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    assert len({r.score for r in got if r.doc_id == 5}) == 1 and len({(r.votes_good, r.votes_bad) for r in got if r.doc_id in (1, 2, 3)}) == 1


def test_language(df, rows):
    got = [(r.doc_id, r.held_out, r.lang_pred) for r in langid.identify(df).collect()]
    assert len(got) == len(rows) and all((p == "und") == (i in (1, 2, 3)) for i, _, p in got if i is not None)


def test_token_counts(df, rows):
    model = token_counts.load(token_counts.default_vocabulary())
    want = [(i, *model.count_batch([t or ""])[0]) for i, t in rows]
    assert sorted(map(key, token_counts.count_tokens(df).collect())) == sorted(map(key, want))


def test_nearest_reads_two_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "e", "e"), (1, [0.5, 0.5], "e", "e")], "vec_id long, `e.v` array<double>, __tm_id string, score string")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, vector="e.v").collect()] == [(0, 1, 0.5)]


def test_pipeline_on_odd_and_empty_tables(spark, df, labels, tmp_path):
    import corpus_pipeline

    plain = df.select("doc_id", "text", "lang", "source", "n_chars")
    for name, docs, tags in (("odd", plain, labels), ("empty", plain.limit(0), labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        tags.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} <= {None, *range(12)} and (name == "odd") == bool(got)
        assert all(r.n_tokens == len(r.token_ids) and math.isfinite(r.n_tokens) for r in got)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_root(Session)


def test_tables_are_dropped(spark):
    table = common.cut(spark.range(5), "some")
    assert table.count() == 5
    common.drop(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table._tm_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
