"""Token counts of a piece model with a whole-token shortcut.

The model's pieces have their space mark only in front (or are nothing but marks; proved on the vocabulary before
use), so no piece reaches over the start of a word, and a text's tokens are those of its words, each a run of spaces
and what follows up to the next space. Offline, every vocabulary string of the form mark + word is encoded once: those
that come back as one token are proved whole. Words of that form count one, without encoding; the rest are merged by
the library, each distinct one once in a block of texts.

Null or empty text: 0 tokens. Null ids are kept. Repeated rows are counted each. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import with_text

MARK = "▁"
MEMORY = 200_000
_RUN = re.compile(r" +[^ ]*")


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def whole_words(path: str) -> frozenset[str]:
    """Words w for which ' ' + w inside a text is one token; raises where the shortcut's conditions don't hold."""
    model = piece_model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in pieces):
        raise ValueError("a piece reaches over the start of a word")
    if model.encode("a  b ", out_type=str) != ["▁a", "▁", "▁b", "▁"] or model.encode("ａ") == model.encode("a"):
        raise ValueError("the model normalises texts")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
    return frozenset(w for w, ids in zip(words, model.encode(words), strict=True) if len(ids) == 1)


def split_words(text: str) -> list[str]:
    """Every run of spaces with what follows up to the next one, less its first space (the model puts one before the
    text). A space mark in the text is a space to the model."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _RUN.findall(" " + text)]
    return text.split(" ")


def _model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or _model_path()
    whole_words(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, whole = piece_model(path), whole_words(path)
        known = dict.fromkeys(whole, 1) | {"": 1}

        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = []
            for text in texts:
                words = split_words(text)
                missing = [w for w in set(words) if w not in known]
                if missing:
                    if len(known) > len(whole) + MEMORY:
                        known = dict.fromkeys(whole, 1) | {"": 1}
                        missing = [w for w in set(words) if w not in known]
                    known.update(zip(missing, map(len, model.encode(missing)), strict=True))
                counts.append(sum(map(known.__getitem__, words)))
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = with_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
