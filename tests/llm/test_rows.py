"""Row-level guarantees: repeated ids, shared set names, links by path, token ids of random text, long entities."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_exact import edited_copies, near_by_force
from tokenizers import Tokenizer

from lodestar.llm import minhash, packing, pii

A, B, C = ("the quick brown fox jumps over the lazy dog near the old river bank", "an entirely different text about the weather in the far north of it", "a third text with nothing in common save a few of the little words")


def kept_rows(spark, rows, schema="doc_id long, text string, note string"):
    docs = spark.createDataFrame([(*r, f"n{i}") if len(r) == 2 else r for i, r in enumerate(rows)], schema)
    return sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicate(docs).collect()), key=str)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, A), (2, B), (2, A)], [(1, A), (2, B)]),
        ([(1, A), (1, A), (1, B)], [(1, A), (1, B)]),
        ([(None, A), (None, A), (3, B), (None, B)], [(3, B), (None, A)]),
        ([(5, None), (5, None), (6, ""), (7, C)], [(5, None), (5, None), (6, ""), (7, C)]),
        ([(2, A), (1, A.upper()), (1, C)], [(1, A.upper()), (1, C)]),
    ],
)
def test_deduplicate_goes_by_row_and_not_by_id(spark, rows, want):
    assert kept_rows(spark, rows) == sorted(want, key=str)


def test_of_equal_rows_the_smallest_stays(spark):
    docs = spark.createDataFrame([(1, A, "b"), (1, A, "a"), (1, A, None)], "doc_id long, text string, note string")
    assert minhash.deduplicate(docs).count() == 1


def test_sets_that_share_a_name_stay_apart(spark, monkeypatch):
    texts = edited_copies(60) + [(1000 + i, f"{A} {i % 7} and {B} {i % 5}") for i in range(40)]
    monkeypatch.setattr(minhash.near_duplicate_links, "__kwdefaults__", {**minhash.near_duplicate_links.__kwdefaults__, "name_bits": 3})
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_force(texts)


def test_hubs_are_dealt_over_parts(spark, monkeypatch):
    texts = edited_copies(150)
    monkeypatch.setattr(minhash, "HUB", 5)
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_force(texts)


def test_signatures_within_the_distance_share_a_bucket():
    """Any two signatures that differ in at most DISTANCE places meet, wherever the differences fall."""
    rng = np.random.default_rng(2)
    places = minhash.CHUNKS * minhash.SYMBOLS
    for _ in range(300):
        differ = rng.choice(places, minhash.DISTANCE, replace=False)
        per_chunk = np.bincount(differ // minhash.SYMBOLS, minlength=minhash.CHUNKS)
        assert per_chunk.min() <= minhash.ERRORS


def test_links_by_path(spark, sf):
    """On plain documents all links come through the multi-index; the join of open members adds only for heavily edited groups."""
    found = minhash.near_duplicate_links(spark.read.parquet(f"{sf}/documents.parquet"))
    assert found.met.exceptAll(found.links).count() == 0 and found.met.count() > 0
    keys = found.nodes.select("sid", F.explode("keys").alias("key"))
    pairs = keys.alias("x").join(keys.alias("y"), "key").select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    assert found.links.join(pairs, ["a", "b"], "left_anti").count() == 0  # every link's ends share a bucket
    edited = minhash.near_duplicate_links(spark.createDataFrame(edited_copies(150), "doc_id long, text string"))
    assert edited.links.count() >= edited.met.count()


def test_token_ids_of_random_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(4)
    alphabet = list("aAzZ09.,!?-'\"()\n\t  éÉİIıßΣσςǅñ́̇中日ñ‍  😀ﬁÅ")
    texts = ["İ.", "İ,", "ΑΣ.", "İstanbul, İ. Σ."] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 24))) for _ in range(6000)]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(t), "<u4").tolist() == want, repr(t)


@pytest.mark.parametrize("text, least", [('api_key = "sk-' + "a1B2" * 40 + '"', 150), ("token: eyJ" + "hbGci0iJ" * 23, 180), ("password=" + "9f" * 64, 128)])
def test_long_secrets_are_found_whole(spark, text, least):
    row = pii.detect(spark.createDataFrame([(1, f"some words before {text} and some after")], "doc_id long, text string"), keep=["doc_id"], with_text=False).first()
    spans = [s.split(":") for s in row["spans"].split(",") if s]
    assert any(int(b) - int(a) >= least for _, a, b in spans), row["spans"]


def test_toxicity_query_on_held_out_rows(spark):
    """Of the held-out texts labelled toxic about two in five hold no marking word at all, so recall can't pass some 0.6 here."""
    from lodestar.llm import queries

    folder = "/root/testdata/sf0.1"
    scored = queries.op3_compression_toxicity(spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("toxic", "score", "predicted").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 50 and len(clean) > 500
    assert np.mean([r["predicted"] for r in toxic]) >= 0.5
    assert np.mean([r["predicted"] for r in clean]) <= 0.08
    assert np.mean([r["score"] for r in toxic]) > np.mean([r["score"] for r in clean]) + 0.2


def test_both_dictionaries_come_from_the_trainer():
    from lodestar.llm import toxicity

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    insults = ["grublin"] + ["".join(rng.choice("bcdfgklmnprtz") + rng.choice("aeiou") for _ in range(4)) for _ in range(15)]
    text = lambda extra: " ".join(rng.choice(words) for _ in range(60)) + extra
    y = [int(i % 3 == 0) for i in range(1500)]
    model = toxicity.train([text(f" you {rng.choice(insults)} {rng.choice(insults)}") if t else text("") for t in y], y)
    assert all(content.startswith(bytes.fromhex("37a430ec")) for content in (model.ordinary, model.toxic))  # the mark of a trained dictionary
    assert b"grubl" in model.toxic and b"grubl" not in model.ordinary
    low, high = model.score(["some words and nothing here", f"some words and a {insults[0]} and {insults[1]} here"])
    assert low < 0.5 < high


def test_archives_with_string_ids_and_breaks_in_them(spark):
    from lodestar.llm import warc

    rows = [("a\r\nX-Page-Id: b", "http://x/", "p" * 200), ("b", "u", "p" * 200), ("", "u", "short"), (None, "u", "p" * 200), ("é ü%41", "u", "q" * 120)]
    for version in (1, 2):
        got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), version=version).collect()}
        assert got == {"a\r\nX-Page-Id: b": (200, "response", None), "b": (200, "revisit", rows[0][0]), "": (5, "response", None), None: (200, "revisit", rows[0][0]), "é ü%41": (120, "response", None)}


def test_plain_and_gzipped_arc_files_are_read(spark, tmp_path):
    import gzip

    from lodestar.llm import warc

    for version in (1, 2):
        folder = tmp_path / str(version)
        folder.mkdir()
        data = warc.arc_header(version, "20240102", "f.arc") + b"".join(warc.arc_record(version, f"http://x/{i}", "20240102030405", b"HTTP/1.1 200 OK\r\n\r\nbody%d" % i) for i in range(3))
        (folder / "a.arc").write_bytes(data)
        (folder / "b.arc.gz").write_bytes(gzip.compress(data))
        rows = warc.read_arc_files(spark, str(folder)).collect()
        assert sorted(r["url"] for r in rows) == sorted([f"http://x/{i}" for i in range(3)] * 2)
        assert {bytes(r["content"])[-5:] for r in rows} == {b"body0", b"body1", b"body2"}


def test_rollup_compacts_and_takes_one_of_two_writers(spark):
    from lodestar.llm import token_rollup

    docs = spark.createDataFrame([("a b c", "s", "en"), ("d", "s", None)], "text string, source string, lang string")
    rollup = token_rollup.RollupStore(spark)
    one = token_rollup.signed_counts(docs, "words-v1", 1)
    assert rollup.commit("x", one) and not rollup.commit("x", one)
    token_rollup._sums(one).write.parquet(f"{rollup._at('x')}/00000000")  # another writer of the same batch
    (spark.createDataFrame([], token_rollup.SCHEMA)).write.parquet(f"{rollup._at('half')}/1")
    want = sorted(map(str, rollup.totals().collect()))
    rollup.compact()
    assert sorted(map(str, rollup.totals().collect())) == want
    assert rollup.commit("y", token_rollup.signed_counts(docs, "words-v1", -1))
    assert rollup.totals().count() == 0
    rollup.compact()
    assert rollup.totals().count() == 0
