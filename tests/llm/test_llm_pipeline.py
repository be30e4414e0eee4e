"""Each stage of the pipeline against a brute-force version on what the stage before it left."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lodestone.llm.mixing import mixed
from lodestone.llm.perplexity import judged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 6))) for _ in range(n))
    passage, base = say(60), [say(120) for _ in range(12)]
    texts = [*base, *base[:4], *(t + " extra" for t in base[4:8]), *(say(50) + " " + passage + " " + say(50) for _ in range(6)), None, "", "few words", "ha " * 400]
    rows = [(i * 5 % 97, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = stages["quality_rules"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    assert set(text(kept)) == {r.doc_id for r in judged(docs).collect() if r.kept}
    assert all(len(WORD.findall(t or "")) >= 20 and not t.startswith("ha ha") for t in text(kept).values()) and kept.count() == docs.count() - 4

    one = stages["minhash_near_dedup"](spark, kept, "").cache()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in text(kept).items():
        w = WORD.findall(t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    # The fixture's links are cliques, so a document goes exactly if it links with a smaller one.
    assert set(text(one)) == {i for i in sets if not any(j < i and near(i, j) for j in sets)}
    assert one.columns == docs.columns

    cut = stages["substring_dedup"](spark, one, "").cache()
    before, first, after = text(one), {}, text(cut)
    for i in sorted(before):
        w = WORD.findall(before[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in before.items():
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        assert WORD.findall(after.get(i) or "") == [x for j, x in enumerate(w) if j not in gone]
    assert any(before[i] != after.get(i) for i in before) and cut.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    drawn = stages["source_mixing"](spark, cut, "").cache()
    assert set(text(drawn)) == {r.doc_id for r in mixed(cut).collect() if r.kept} and drawn.columns == docs.columns
    assert text(drawn).items() <= text(cut).items()

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in text(drawn).items()}
    pieces = stages["sequence_packing"](spark, drawn, "").collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {"doc_id", "start", "length", "sequence_id"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)
