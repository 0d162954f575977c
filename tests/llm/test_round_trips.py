"""Byte-level BPE against tiktoken, base secrets against `re`, chat digests against the source rows."""

import base64
import hashlib
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from ragloom.llm.byte_bpe import byte_bpe, digests
from ragloom.llm.quality_rules import op9_quality_rules
from ragloom.llm.secret_scan import op10_secret_scan

TEXTS = [None, "", " ", "a", "Hello  world\n\n'tis 12345 naïve 漢字 🙂\t", "x" * 3000, "aaaa bbbb " * 400, "<|endoftext|> \u0000\x7f é"]


def documents(spark, folder, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_bpe_equals_tiktoken(spark, tmp_path):
    _, rows = documents(spark, tmp_path, TEXTS)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests(byte_bpe(docs, path=path, pattern=public_tokenizers.PATTERN)).collect())
    want = []
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_base_secrets_equal_re(spark, tmp_path):
    texts = [None, "", "é password = 'abcdef' API_KEY:xyz12 token=abc.def-1", "AKIA" + "A1" * 8 + " AKIA12 " + "0f" * 12 + "g" + "ab" * 5, "Secret: " + "0123456789abcdef" * 3]
    folder, rows = documents(spark, tmp_path, texts)
    kinds = [(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    names, want = ("assign", "access", "hex"), []
    for i, text in rows:
        found = [[(m.start(), k, m.end()) for m in re.finditer(p, text or "") if ok(m)] for k, (p, ok) in enumerate(kinds)]
        spans = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(sum(found, [])))
        want.append((i, *map(len, found), hashlib.sha256(spans.encode()).hexdigest()))
    got = [tuple(r) for r in op10_secret_scan(spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()]
    assert sorted(got) == sorted(want)


def test_quality_rules_on_empty_and_null(spark, tmp_path):
    folder, _ = documents(spark, tmp_path, [None, "", "one two\none two\n"])
    got = {r["doc_id"]: (r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"]) for r in op9_quality_rules(spark, folder).collect()}
    assert got == {0: (0, 0, True, False), 1: (0, 0, True, False), 2: (4, 1, True, False)}
