"""The corpus pipeline, stage by stage, against brute force on planted rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, brute_classes, words

import corpus_pipeline as C
from pairforge.llm import decontam
from conftest import SMALL
from pairforge.session import materialize, scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture(scope="module")
def corpus(shipped):
    rng = random.Random(21)
    item = words(rng, 30)
    rows, toxic = [], {}

    def add(text, bad=0):
        i = len(rows)
        rows.append((i, text, "en", f"s{min(i % 7, 3)}", None if text is None else len(text), "clash"))
        toxic[i] = bad
    for i in range(400):
        sentences = [words(rng, 9, 400) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            sentences[-1] += " vileness"
        add(". ".join(sentences), int(i % 4 == 0))
    for _ in range(10):  # near copies
        base = words(rng, 120).split()
        for _ in range(4):
            base[rng.randrange(120)] = "altered"
            add(" ".join(base))
    for _ in range(10):
        add(f"{words(rng, 60)} {item} {words(rng, 60)}")
    for t in ODD:
        add(t)
    path = scratch_path(shipped, "pipeline-test")
    shipped.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    shipped.createDataFrame([(i, y) for i, y in toxic.items() if i < 400], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    shipped.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, toxic, item


@pytest.fixture(scope="module")
def outputs(shipped, corpus):
    docs, out = shipped.read.parquet(f"{corpus[0]}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out[name] = docs = materialize(stage(shipped, docs, corpus[0]), f"test-{name}")
    return out


def test_stage_order_and_columns(outputs):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, df in outputs.items():
        assert df.columns == [c.split()[0] for c in DOCS.split(", ")], name


def test_toxic_documents_go_and_clean_ones_stay(outputs, corpus):
    kept = {r.doc_id for r in outputs["toxicity"].collect()}
    wrong = sum((i in kept) == bool(bad) for i, bad in corpus[2].items())
    assert wrong <= 2


def test_one_document_of_each_class_stays(outputs):
    before = sorted(outputs["toxicity"].collect(), key=lambda r: r.doc_id)
    roots, sizes = brute_classes([r.text for r in before], 5, 4, 5)
    want = {before[r].doc_id for r in set(roots)}
    assert {r.doc_id for r in outputs["near_duplicates"].collect()} == want


def test_passages_are_cut_and_the_rest_stays(outputs, corpus):
    before = {r.doc_id: r for r in outputs["near_duplicates"].collect()}
    after = {r.doc_id: r for r in outputs["decontamination"].collect()}
    grams = decontam.NgramSet([("1", corpus[3])])
    hit = {i for i, r in before.items() if corpus[3] in (r.text or "")}
    assert hit and set(after) == set(before)
    for i, r in after.items():
        if i in hit:
            assert r.text.split() == before[i].text.replace(corpus[3], " ").split() and r.n_chars == len(r.text)
            assert not list(grams.hits(decontam.Words([r.text.encode()], decontam.ALNUM)))
        else:
            assert r == before[i]


def test_mixture_keeps_every_document(outputs):
    before = Counter(r.doc_id for r in outputs["decontamination"].collect())
    rows = outputs["mixing"].collect()
    assert set(before) == {r.doc_id for r in rows}
    n = Counter(r.source for r in outputs["decontamination"].collect())
    share = Counter(r.source for r in rows)
    total = sum(c ** 0.7 for c in n.values())
    assert all(abs(share[s] / len(rows) - n[s] ** 0.7 / total) < 0.1 for s in n)


def test_shards_are_near_equal(outputs):
    size = Counter()
    rows = outputs["sharding"].collect()
    for r in rows:
        size[r.shard] += len((r.text or "").encode()) + 8
    big = max(len((r.text or "").encode()) for r in rows)
    assert set(size) <= set(range(24)) and max(size.values()) <= sum(size.values()) / 24 + 3 * big


def test_run_equals_the_stages(shipped, corpus, outputs):
    got = Counter(tuple(r) for r in C.run(shipped, corpus[0]).collect())
    assert got == Counter(tuple(r) for r in outputs["sharding"].collect())


def test_stages_take_empty_tables(shipped, corpus):
    empty = shipped.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        assert stage(shipped, empty, corpus[0]).count() == 0, name


CLASHING = ["_h", "_k", "_r", "_n", "_tox", "_range", "_at", "_sid", "_key", "_no", "_p", "_g", "_off", "_lists", "size", "id", "xh", "cls", "h", "k",
            "text_crc32", "law", "slot", "own_0_mix_slot", "mix_slot", "mix_block", "c0", "c3"]


@pytest.mark.parametrize("stage", [s for s in C.STAGES], ids=lambda s: s[0])
def test_columns_named_like_the_library_s_own_stay(shipped, stage):
    """Extra columns named like those operators add on the way keep their values."""
    rows = [(i, f"common words of document {i} and {i * 7} with some more of them {'x' * (i % 5)}", "en", f"s{i % 3}", 10) for i in range(60)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING}).repartition(3)
    out = stage[1](shipped, docs, SMALL)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = out.collect()
    assert len({r.doc_id for r in got}) > 40
    assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in CLASHING)


def test_shards_of_text_ids(shipped):
    from pairforge.llm import sharding
    ids = [f"doc-{i}" for i in range(500)] + ["17", "007", "9" * 30, None, "1.5", ""]
    docs = shipped.createDataFrame([(i, f"text {n} " * (n % 50)) for n, i in enumerate(ids)], "doc_id string, text string").repartition(4)
    got = sharding.shard_rows(docs, shards=5).collect()
    assert len(got) == len(ids) and {r.shard for r in got} == set(range(5))
    mean = sum(r.size for r in got) / 5
    per = {s: sum(r.size for r in got if r.shard == s) for s in range(5)}
    assert all(abs(b - mean) <= max(r.size for r in got) for b in per.values())
    where = {r.doc_id: r.shard for r in got}
    assert all(where[r.doc_id] == r.shard for r in sharding.assign_shards(docs, shards=5).collect())
