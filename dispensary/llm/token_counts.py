"""Token counts: each distinct pre-token is counted once, and the counts are summed over a document's pre-tokens.

A pre-token is a run without ASCII white space.  For a tokenizer that drops white space no token crosses such a
run's border, nor does its normaliser change a text differently next to white space, so a text has as many tokens as its
pre-tokens together, special strings inside them included.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensary.llm import _dictionary as D
from dispensary.llm._spark import documents
from dispensary.llm.sentencepiece_codec import check_model, chunk_lists


def _counter(kind: str, model: bytes):
    """f(texts) -> number of tokens of each."""
    if kind == "model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a chunk stands without its first marker; the marker alone is one token
        return lambda texts: [len(own) if x else 1 for own, x in zip(sp.encode(texts, num_threads=1), texts, strict=True)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _check_json(model: bytes) -> None:
    """ValueError unless white space is dropped, no token of the vocabulary or added one holds it or takes it from beside
    itself, and texts of odd words have the counts of their words, whatever white space stands between them."""
    spec, count = json.loads(model), _counter("json", model)
    added = spec.get("added_tokens") or []
    spaced = [x for x in (*spec["model"].get("vocab", {}), *(t["content"] for t in added)) if isinstance(x, str) and re.search(r"\s", x)]
    odd = ["a", "B", "x9", "it's", "'s", "\u0301e", "e\u0301", "\u03a3", "\u00df\u03a3", "\u65e5\u672c", "12.5", "!?", "\U0001f642", *(t["content"] for t in added)]
    pairs = [(x, y, w) for x in odd for y in odd for w in (" ", "\n", "\t \r\n", "\x0b\x0c")]
    alone = dict(zip(odd, count(odd), strict=True))
    whole = count([f" {x}{w}{y}\n" for x, y, w in pairs])
    if spaced or any(t.get("lstrip") or t.get("rstrip") for t in added) or any(n != alone[x] + alone[y] for n, (x, y, _) in zip(whole, pairs, strict=True)):
        raise ValueError("this tokenizer keeps white space; its counts can't be summed over runs without it")


def token_counts(docs: DataFrame, model_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = D.BLOCK_BYTES, fan: int = D.FAN) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    A .json file is read by the tokenizers library, a .model file by sentencepiece; no special tokens are added,
    special strings inside texts are handled as the library does, nothing is truncated or padded.  Null and empty
    texts have 0 bytes and tokens; a very long text is a block of its own and is counted whole.  Repeated rows and ids give a row
    each; an empty table gives an empty result; other columns, whatever their names, are ignored.  A tokenizer for which the sum would be wrong is refused.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = "model" if model_path.endswith(".model") else "json"
    check_model(model) if kind == "model" else _check_json(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one file of the model's size
    docs = documents(docs, id_col, text_col)
    blocks = D.coded(docs, chunk_lists if kind == "model" else None, frequencies=True, block_bytes=block_bytes)

    def make():
        count = _counter(kind, shared.value)
        return lambda distinct: [np.uint32(x).tobytes() for x in count([x.decode() for x in distinct])]

    def finish(ids, words, results, n_pieces, n_bytes, codes, times):
        count = np.frombuffer(b"".join(results), np.uint32).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count[codes] * times) if len(codes) else codes))
        ends = np.concatenate(([0], np.cumsum(n_pieces)))
        return [ids, n_bytes, total[ends[1:]] - total[ends[:-1]]]

    out = D.joined_back(blocks, D.each_distinct(blocks, make, D.expected_blocks(docs, block_bytes), fan), finish, "id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
