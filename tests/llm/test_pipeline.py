"""Every stage of the pipeline against brute force on what the stage before kept."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from .cases import DOCS
from .test_jaccard_join import near_copies, shingles
from .test_suffix_dedup import WORD
from .test_suffix_dedup import brute as repeated


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices(["th", "er", "on", "an", "re", "é"], k=rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(60)
    texts = [prose(rnd.randint(5, 400)) for _ in range(300)]
    for i in range(0, 60, 5):
        texts[i] += "\n" + passage + "\n" + prose(150)
    texts += [t.replace(" ", "  ") for t in texts[100:120]] + [prose(2500)]
    for t in texts[120:126]:
        texts += near_copies(rnd, t.split(" "), 5, 3)
    junk = [" ".join(w + rnd.choice(["***", "$$$"]) for w in prose(rnd.randint(30, 200)).split()) for _ in range(80)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)]
    labels = [(d, int(d < 10_000), 0) for d, *_ in rows if d % 2 or d >= 10_000]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/out{k}")
        out.append(spark.read.parquet(f"{folder}/out{k}"))
    return folder, out, [{r.doc_id: r.text for r in df.collect()} if "text" in df.columns else None for df in out]


def test_all_but_the_last_keep_the_columns(stages):
    _, frames, _ = stages
    assert [df.columns for df in frames[1:-1]] == [frames[0].columns] * 4
    assert len(corpus_pipeline.STAGES) == 5


def test_classifier_rejects_junk(stages):
    _, _, texts = stages
    kept = set(texts[1])
    assert sum(d >= 10_000 for d in kept) <= 4 and sum(d < 10_000 for d in kept) >= len(texts[0]) - 80 - 6


def test_exact_copies(stages):
    _, _, texts = stages
    groups = {}
    for doc_id, text in texts[1].items():
        groups.setdefault("".join(text.split()), []).append((-len(text), doc_id))
    assert set(texts[2]) == {min(g)[1] for g in groups.values()}


def test_near_copies(stages):
    _, _, texts = stages
    ids = sorted(texts[2])
    sets = {i: shingles(texts[2][i], 5) for i in ids}
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert set(texts[3]) == set(label.values()) and len(texts[3]) < len(texts[2])


def test_repeated_passages(stages):
    _, _, texts = stages
    ids = sorted(texts[3])
    _, copies = repeated([texts[3][i] for i in ids], 50)
    assert copies
    for k, i in enumerate(ids):
        want = [m.group() for m in WORD.finditer(texts[3][i]) if (k, m.start()) not in copies]
        assert WORD.findall(texts[4].get(i, "")) == want


def test_packing_has_every_token_once(stages):
    _, frames, texts = stages
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = frames[5].collect()
    places = {}
    for r in rows:
        ids = np.array(tokenizer.encode(texts[4][r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {r.doc_id for r in rows} == set(texts[4])
    for own in places.values():
        assert sum(n for _, n in own) <= 1024
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 1024) + 3


def test_run_gives_the_last_stage(spark, stages):
    folder, frames, _ = stages
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select(columns).collect())) == sorted(
        map(tuple, frames[5].select(columns).collect())
    )


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
