"""Each stage of the pipeline on what its predecessor kept: what goes, what stays, odd rows and clashing columns."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, found string, matches long, node string, label string"
SYLLABLES = {"en": ("th", "ow", "ing", "sh", "ea", "ly"), "de": ("sch", "ung", "ei", "ver", "zu", "tz")}


def words(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(n)]


def row(doc_id, text, lang):
    return (doc_id, text, lang, "s", len(text or ""), "k", "f", 1, "n", "l")


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """(folder, rows, doc_ids that each stage drops)."""
    rng = random.Random(11)
    texts = {}
    for i in range(120):
        lang = ("en", "de")[i % 2]
        texts[i] = (words(rng, lang, rng.randint(40, 80)), lang)
    item = words(rng, "en", 40)
    rows = [row(i, " ".join(w), lang if i % 7 else None) for i, (w, lang) in texts.items()]
    rejected = {200, 201, 202}
    rows += [row(200, None, "en"), row(201, "", "en"), row(202, "12 ... 34", "de")]
    copies = {210, 211, 212}
    edited = [*texts[5][0][:-1], "verzutz"]
    rows += [row(210, " ".join(texts[3][0]), "de"), row(211, " ".join(texts[4][0]).upper(), "en"), row(212, " ".join(edited), "de")]
    rows += [row(6, " ".join(texts[6][0]), "en")]  # a repeated row
    tainted = {220}
    rows += [row(220, " ".join([*words(rng, "en", 30), *item[20:], *words(rng, "en", 30), *item[:20]]), "en")]  # reordered
    rows += [row(230, " ".join(words(rng, "en", 50)) + ' password = "hunter22-x9"', "en")]
    rows += [row(240, " ".join(words(rng, "de", 40_000)), "de"), row(None, " ".join(words(rng, "de", 50)), "de")]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, {"language_id": rejected, "simhash_dedup": copies, "decontamination": tainted, "secret_scan": set()}


def written(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, case, tmp_path):
    folder, rows, drops = case
    df = spark.read.parquet(f"{folder}/documents.parquet")
    before = sorted((r.doc_id for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = written(spark, stage(spark, df, folder), str(tmp_path / name))
        assert df.columns == [f.split()[0] for f in SCHEMA.split(", ")], name
        after = sorted((r.doc_id for r in df.collect()), key=str)
        expected = [i for i in before if i not in drops[name]]
        if name == "simhash_dedup":  # one row of the repeated document stays
            expected = sorted(set(expected), key=str)
        assert after == expected, name
        before = after
    kept, own = {r.doc_id: r for r in df.collect()}, {r[0]: r for r in rows}
    assert all(r.lang is not None and r.n_chars == len(r.text) for r in kept.values())
    assert all(r.lang == ("en", "de")[i % 2] for i, r in kept.items() if i is not None and i < 120)
    assert "hunter22" not in kept[230].text and "[SECRET]" in kept[230].text
    assert all(r.text == own[i][1] and r.found == "f" and r.matches == 1 for i, r in kept.items() if i != 230)
    library, at = Tokenizer.from_file(tokenizer_path()), {}
    bins = {}
    for p in corpus_pipeline.STAGES[-1][1](spark, df, folder).collect():
        at.setdefault(p.doc_id, []).append(p)
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, pieces in at.items():
        ids = np.array([*library.encode(kept[i].text, add_special_tokens=False).ids, 0], "<u4")
        base = min(p.start for p in pieces)
        for p in pieces:
            assert zlib.crc32(ids[p.start - base : p.start - base + p.length].tobytes()) == p.ids_crc32
        assert sum(p.length for p in pieces) == len(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
    assert set(at) == set(kept)
    for own_bin in bins.values():
        end = 0
        for offset, length in sorted(own_bin):
            assert offset == end
            end += length
        assert end <= 1024


def test_empty_tables(spark, case, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
