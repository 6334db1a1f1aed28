"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is run through the merges once: those that come out as one
token are proven whole.  A text is split into pre-tokens; a proven one counts 1 without any merge,
and only the others go through the merges, each distinct one once for as long as it stays in a
worker's table (bounded, emptied when full: that costs time, never counts).

Defined results: a null text counts as empty, with 0 tokens; added (also special) strings inside a
text are one token each, as the library's default has them; a vocabulary without such strings has
none; rows without id and repeated rows are counted like any; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, text_of

#: The library's name for the vocabulary file; a path may be given instead.
VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 200_000
#: Texts with more tokens are over the limit.
LIMIT = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def vocabulary_json(name: str = VOCABULARY) -> str:
    """The file's contents: read by the driver and sent on, since executors need not have the file."""
    with open(vocabulary_path(name), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: a printable Latin-1 byte is
    itself, the others take the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def proven_whole(contents: str) -> list[str]:
    """The vocabulary's strings, as text, that encode alone as one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(contents).model
    vocabulary = json.loads(contents)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    whole = []
    for piece in vocabulary:
        if all(c in byte_of for c in piece) and len(model.tokenize(piece)) == 1:
            try:
                whole.append(bytes(byte_of[c] for c in piece).decode())
            except UnicodeDecodeError:  # part of a character: never a pre-token of its own
                pass
    return whole


class PreTokens(dict):
    """Tokens of a pre-token: 1 for the proven ones, the others by the merges when first met."""

    def __init__(self, contents: str, whole: list[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model = whole, Tokenizer.from_str(contents).model
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_letters())})

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    contents, pattern = vocabulary_json(vocabulary), public_tokenizers.PATTERN
    # added strings stand for themselves wherever they occur, the longest first where one starts another
    added = sorted((t["content"] for t in json.loads(contents).get("added_tokens", []) if t["content"]), key=len, reverse=True)
    shared = docs.sparkSession.sparkContext.broadcast((contents, proven_whole(contents)))  # as large as the vocabulary

    def counted(batches):
        import regex

        split = regex.compile(pattern).findall
        apart = regex.compile("|".join(map(regex.escape, added))).split if added else lambda body: [body]
        table = PreTokens(*shared.value)
        one = table.__getitem__
        for batch in batches:
            found = []
            for body in batch.column(1).to_pylist():
                parts = apart(body)
                found.append(len(parts) - 1 + sum(sum(map(one, split(p))) for p in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    body = text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.octet_length(body).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op8_token_count": op8_token_count}
