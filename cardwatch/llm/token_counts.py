"""Token counts of whole texts."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that go to the tokenizer in one call, and words remembered per Python worker.
CALL_BYTES = 1 << 20
CACHED_WORDS = 1 << 19


def balanced(pieces: list[bytes], most: int = CALL_BYTES) -> Iterator[list[bytes]]:
    """Lists of pieces of about ``most`` bytes each; a longer piece stands alone."""
    batch, size = [], 0
    for piece in pieces:
        if batch and size + len(piece) > most:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece)
    if batch:
        yield batch


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row, as the tokenizer of a ``.json`` file counts the whole text.

    Texts are cut at ASCII white space. This is safe for tokenizers that split words at white space and drop it, as
    the one with word ends does: no normalisation, special string or merge reaches across it. A text of any length is
    therefore a stream of short pieces. Each distinct piece of a batch is encoded once, in calls that hold about the
    same number of bytes, and only lengths come back. Begin, end and other special tokens are not added; special
    strings inside a text are treated as the tokenizer does by default.

    A null text counts as empty (no bytes, no tokens). Null and repeated ids keep their rows. Other columns are not
    read. There is no shuffle.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1).cast(pa.binary()):
                text = value.as_py() or b""
                words = text.split()  # bytes split at ASCII white space only
                if len(known) > CACHED_WORDS:
                    known.clear()
                fresh = list({w for w in words if w not in known})
                for call in balanced(fresh):
                    encoded = tokenizer.encode_batch_fast([w.decode() for w in call], add_special_tokens=False)
                    known.update(zip(call, map(len, encoded)))
                sizes.append(len(text))
                tokens.append(sum(map(known.__getitem__, words)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    return source.mapInArrow(lengths, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", "doc_id")
