"""Token counts: texts are encoded in Arrow batches on the executors and only lengths come back.

Long texts are cut at safe boundaries, and the pieces are encoded in batches of about equal bytes. A
boundary is safe if no token can span it: for a piece vocabulary with a dummy prefix, one single space
between two characters that are neither a space nor the prefix mark. The right part loses that
space, because its own dummy prefix puts it back. This holds if no vocabulary entry has the mark after
another character, which is checked when the model is loaded; otherwise texts are not cut.

Defined results: null counts as the empty text (0 tokens); repeated rows are counted each; an empty
table gives an empty result. Nothing is shuffled; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut(text: str, size: int) -> list[str]:
    """Parts of at least ``size`` characters (but for the last), cut at safe boundaries only."""
    parts, begin = [], 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while at >= 0 and (at + 1 >= len(text) or at == 0 or text[at - 1] in " ▁" or text[at + 1] in " ▁"):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[begin:at])
        begin = at + 1
    parts.append(text[begin:])
    return parts


class PieceCounter:
    """Counts tokens with a piece model; ``safe`` tells whether texts may be cut."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        inside = any(MARK in p.lstrip(MARK) for p in pieces)
        # "a" must come out with a dummy prefix, and spaces must be kept as they are
        plain = self.model.encode("a", out_type=str)[0].startswith(MARK) and len(self.model.encode("a  b")) > len(self.model.encode("a b"))
        self.safe = plain and not inside

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def counter(model: str, cut_chars: int, batch_bytes: int):
    def run(batches):
        tool = PieceCounter(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            n_tokens = np.zeros(batch.num_rows, np.int64)
            parts: list[str] = []
            owner: list[int] = []
            held = 0
            for row in range(batch.num_rows):
                if not sizes[row]:
                    continue
                text = texts[row].as_py()
                for part in cut(text, cut_chars) if tool.safe and len(text) > cut_chars else [text]:
                    parts.append(part)
                    owner.append(row)
                    held += len(part) if part.isascii() else len(part.encode())
                    if held >= batch_bytes:
                        np.add.at(n_tokens, owner, tool.count(parts))
                        parts, owner, held = [], [], 0
            if parts:
                np.add.at(n_tokens, owner, tool.count(parts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(n_tokens)], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, cut_chars: int = 16_384, batch_bytes: int = 1 << 18) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row.

    model: the piece model's path, the same on all executors. cut_chars: texts beyond it are cut.
    batch_bytes: UTF-8 bytes that one call of the encoder gets, whatever the number of texts; a text without a place to cut is one call.
    """
    run = counter(model or default_model(), cut_chars, batch_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract: piece_bpe_32k.model, limit 4096."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
