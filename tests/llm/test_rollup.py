import random
import re
from collections import Counter

import pytest
from loreforge.llm.rollup import BYTES_50K, MULTI_50K, Tokenizer, TokenRollup, op3_token_rollup
from loreforge.llm.storage import shared_path

PIECES = Tokenizer("piece_bpe_32k", "sentencepiece", "piece_bpe_32k.model")
HF = Tokenizer("byte_bpe_50k_hf", "tokenizers", "byte_bpe_50k.json")
SCHEMA = "seq int, op string, doc_id long, source string, lang string, text string, tokens string"


def brute(batches, tokenizers):
    count = {t.version: t.counter() for t in tokenizers}
    docs, loose, seen = {}, [], set()
    for name, rows in batches:
        if name in seen:
            continue
        seen.add(name)
        for _, op, i, source, lang, text, _ in sorted(rows, key=lambda r: r[0]):
            docs.pop(i, None)
            if op != "delete":
                if i is None:
                    loose.append((source, lang, text))
                else:
                    docs[i] = (source, lang, text)
    n, tokens = Counter(), Counter()
    for source, lang, text in [*docs.values(), *loose]:
        for v, c in count.items():
            n[source, lang, v] += 1
            tokens[source, lang, v] += c(text) if text else 0
    return {(*k, n[k], tokens[k]) for k in n}


def test_batches(spark):
    rng = random.Random(11)
    tokenizers = (BYTES_50K, PIECES, HF)
    rollup = TokenRollup(spark, shared_path(spark, "test"), tokenizers)
    batches = []
    for b in range(4):
        rows = [(s, rng.choice(["insert", "revise", "delete"]), rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([None, "", "some words <|endoftext|> é日本", "x " * rng.randint(0, 50)]), "") for s in range(20)]
        batches.append((f"b{b}", rows))
    batches.insert(2, batches[0])
    batches.append(("empty", []))
    batches.append(batches[1])
    for i, (name, rows) in enumerate(batches):
        assert rollup.commit(name, spark.createDataFrame(rows, SCHEMA)) == (name not in [n for n, _ in batches[:i]])
        assert {tuple(r) for r in rollup.totals().collect()} == brute(batches[: i + 1], tokenizers)


def test_half_written_batch_is_redone(spark):
    path = shared_path(spark, "test")
    rollup = TokenRollup(spark, path)
    rows = spark.createDataFrame([(0, "insert", 1, "a", "en", "one two", "")], SCHEMA)
    rollup.commit("b", rows)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-b/totals-1/_SUCCESS")
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, False)
    assert rollup.totals().count() == 0 and rollup.committed() == []
    assert rollup.commit("b", rows) and rollup.totals().first().n_docs == 1


def test_wrong_input(spark):
    rollup = TokenRollup(spark, shared_path(spark, "test"))
    with pytest.raises(ValueError):
        rollup.commit("../x", spark.createDataFrame([], SCHEMA))
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("x", spark.createDataFrame([(0, "upsert", 1, "a", "en", "t", "")], SCHEMA))


def test_ids_of_any_type_and_long_texts(spark):
    rollup = TokenRollup(spark, shared_path(spark, "test"))
    rows = [(0, "insert", "x", "a", "en", "one " * 300_000, ""), (1, "insert", "y", "a", "en", None, ""), (2, "insert", None, "a", "en", "one", ""), (3, "insert", None, "a", "en", "one", "")]
    kind = SCHEMA.replace("doc_id long", "doc_id string")
    rollup.commit("a", spark.createDataFrame(rows, kind))
    rollup.commit("b", spark.createDataFrame([(0, "delete", "x", None, None, None, ""), (1, "delete", None, None, None, None, "")], kind))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "byte_bpe_50k", 3, 2)}


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "text").collect()
    seen, batch = set(), []
    for r in sorted(rows):
        if r.text not in seen or r.text is None:
            batch.append((0, "insert", r.doc_id, r.source, r.lang, r.text and re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text).strip(" "), ""))
        seen.add(r.text)
    assert {tuple(r) for r in op3_token_rollup(spark, small).collect()} == brute([("load", batch)], (BYTES_50K, MULTI_50K))


def test_lookups_read_a_whole_table_and_the_batches_after_it(spark, monkeypatch):
    from loreforge.llm import rollup as R

    monkeypatch.setattr(R, "COMPACT", 3)
    rng = random.Random(8)
    rollup = TokenRollup(spark, shared_path(spark, "test"))
    batches = []
    for b in range(8):
        rows = [(s, rng.choice(["insert", "revise", "delete"]), rng.choice([None, *range(6)]), rng.choice(["a", None]), "en", rng.choice([None, "one two three"]), "") for s in range(6)]
        batches.append((f"b{b}", rows))
        rollup.commit(f"b{b}", spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in rollup.totals().collect()} == brute(batches, (BYTES_50K,))
    read = {f.split("/")[-2] + "/" + f.split("/")[-3] for f in rollup._recent().inputFiles()}
    assert read == {"standing/batch-b5", "rows/batch-b6", "rows/batch-b7"}
