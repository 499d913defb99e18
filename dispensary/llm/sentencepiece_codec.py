"""SentencePiece encoding and decoding through a table of distinct chunks.

The text is one leading marker and its characters, with spaces as markers.  A chunk is a run of markers and the
characters up to the next marker.  In a vocabulary where no piece has a marker after another character, no
merge crosses a chunk's border, so a chunk's pieces don't depend on its neighbours: each distinct chunk is
segmented once by the library, and the ids are joined back by position.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from dispensary.llm import _dictionary as D
from dispensary.llm._spark import documents

_CHUNK = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces for the others."""
    return [x[1:].replace("▁", " ") for x in _CHUNK.findall(" " + text)] if text else []


def chunk_lists(texts: pa.Array) -> pa.ListArray:
    """The same for an array of texts; those with single spaces between words alone are cut all at once."""
    odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.or_(pc.match_substring(texts, "▁"), pc.equal(texts, "")))
    places = np.concatenate((np.flatnonzero(~np.asarray(odd)), np.flatnonzero(np.asarray(odd))))
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    rest = pa.array([chunks(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
    return pa.concat_arrays([plain.cast(rest.type), rest]).take(pa.array(np.argsort(places)))


def check_model(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The model, if chunks are independent under it and spaces are kept as they are."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search("[^▁]▁", p)]
    probe = "  a \t\n  b ﬁ "
    if crossing or sp.decode(sp.encode(probe)) != probe or sp.piece_to_id("▁") == sp.unk_id():
        raise ValueError("this model's pieces cross white space, or it changes white space; chunks would depend on each other")
    return sp


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = D.BLOCK_BYTES, fan: int = D.FAN) -> DataFrame:
    """(id, n_tokens, ids, decoded): all ids as decimals joined by commas, and the library's decoding of them.

    Whole texts, without begin or end ids and without sampling.  Null and empty texts have no ids and decode to an
    empty text.  A very long text is a block of its own and is encoded whole.  Repeated rows and ids give a row each; an empty table
    gives an empty result; other columns, whatever their names, are ignored.  A model whose pieces cross white-space markers is refused.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one file of the model's size
    docs = documents(docs, id_col, text_col)
    blocks = D.coded(docs, chunk_lists, frequencies=False, block_bytes=block_bytes)

    def make():
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        marker = sp.piece_to_id("▁")

        def segment(distinct: list[bytes]) -> list[bytes]:
            texts = [x.decode() for x in distinct]
            ids = [own if x else [marker] for own, x in zip(sp.encode(texts, num_threads=1), texts, strict=True)]
            back = sp.decode(ids, num_threads=1) if ids else []
            # the decoded text follows only where it is not the chunk itself
            return [",".join(map(str, own)).encode() + (b"" if y == x else b";" + y.encode()) for own, x, y in zip(ids, texts, back, strict=True)]

        return segment

    def finish(ids, words, results, n_pieces, n_bytes, codes, times):
        back = list(words)
        for i in [i for i, x in enumerate(results) if b";" in x]:
            results[i], _, back[i] = results[i].partition(b";")
        count = np.array([x.count(b",") + 1 for x in results], np.int64)
        ends = np.concatenate(([0], np.cumsum(n_pieces))).tolist()
        total = np.concatenate(([0], np.cumsum(count[codes]) if len(codes) else codes))
        joined, decoded = [], []
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            own = codes[i:j].tolist()
            joined.append(b",".join([results[c] for c in own]))
            decoded.append(b" ".join([back[c] for c in own]))
        texts = [pa.array(x, pa.large_binary()).cast(pa.large_string()).cast(pa.string()) for x in (joined, decoded)]
        return [ids, total[ends[1:]] - total[ends[:-1]], *texts]

    return D.joined_back(blocks, D.each_distinct(blocks, make, D.expected_blocks(docs, block_bytes), fan), finish, "id long, n_tokens long, ids string, decoded string")
