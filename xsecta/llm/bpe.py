"""Byte-level BPE encoding and decoding with tree concatenation for long texts."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Characters of a leaf of the tree; longer texts are halved until they are this short.
LEAF = 16_384
#: Tokens on each side of a join in the first window, and how many must agree at each end.
WINDOW, AGREE = 16, 4
#: Pretokens that the cache of a Python worker holds before it is emptied.
CACHE = 400_000


class Codec:
    """Encodes as the tokenizers library does for a byte-level BPE file without normalizer.

    Texts are cut into pretokens, and the library encodes each distinct pretoken once: a pretoken's ids don't depend on
    its neighbours. Texts that hold the string of a special token go to the library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library's white space is Unicode's; that of Python's \s also has \x1c-\x1f
        self.cut = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.bytes |= {i: x.content.encode() for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.known: dict[str, tuple[str, bytes, tuple[int, ...]]] = {}

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        for w in new:
            ids = concatenated(w, self._library, self.bytes) if len(w) > LEAF else self._library(w)
            self.known[w] = (",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids)), tuple(ids))

    def _parts(self, text: str) -> list[tuple[str, bytes, tuple[int, ...]]]:
        words = self.cut(text)
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            self._learn(words)
            known = self.known
            return [known[w] for w in words]

    def _whole(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str) -> list[int]:
        if self._whole(text):
            return self._library(text)
        return [i for p in self._parts(text) for i in p[2]]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, sha256 of the ids, sha256 of the decoded text."""
        if self._whole(text):
            return self.digest_ids(self._library(text))
        parts = self._parts(text)
        ids = ",".join([p[0] for p in parts]).encode()
        raw = b"".join([p[1] for p in parts])
        return (ids.count(b",") + 1 if ids else 0), hashlib.sha256(ids).hexdigest(), hashlib.sha256(readable(raw)).hexdigest()

    def decode(self, ids) -> str:
        return readable(b"".join(map(self.bytes.__getitem__, ids))).decode()

    def digest_ids(self, ids) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def readable(raw: bytes) -> bytes:
    """raw as UTF-8, with U+FFFD for what isn't."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _aligned(raw: bytes) -> bool:
    """Whether raw starts at the start of a character."""
    return not raw or raw[0] & 0xC0 != 0x80


def joined(left: list[int], right: list[int], encode, token_bytes) -> list[int]:
    """The ids of two neighbouring texts' concatenation, from the ids of each.

    A window of tokens around the join, widened to whole characters, is encoded anew. If its first AGREE tokens are those
    of the left side and its last AGREE tokens those of the right side, all that it doesn't cover stands as it was: each
    pair of neighbours has then been seen in a valid encoding, and merges look no further than at pairs. Else the window
    doubles; a window that reaches an end of the text needs no agreement there.
    """
    if not left or not right:
        return left or right
    size = WINDOW
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        while a > 0 and not _aligned(token_bytes[left[a]]):
            a -= 1
        while b < len(right) and not _aligned(token_bytes[right[b]]):
            b += 1
        old_a, old_b = left[a:], right[:b]
        new = encode(b"".join(token_bytes[i] for i in old_a + old_b).decode())
        start_ok = a == 0 or (len(new) > AGREE and new[:AGREE] == old_a[:AGREE])
        end_ok = b == len(right) or (len(new) > AGREE and new[-AGREE:] == old_b[-AGREE:])
        if start_ok and end_ok:
            return left[:a] + new + right[b:]
        size *= 2


def merged(leaves: list[list[int]], encode, token_bytes) -> list[int]:
    """Joins neighbours pairwise, level by level, until one is left."""
    while len(leaves) > 1:
        leaves = [joined(leaves[i], leaves[i + 1], encode, token_bytes) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def concatenated(text: str, encode, token_bytes, leaf: int = LEAF) -> list[int]:
    """Tree concatenation within one process."""
    return merged([encode(text[i : i + leaf]) for i in range(0, len(text), leaf)], encode, token_bytes)


def _digests(path: str):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            got = [c.digest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _leaves(path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            ids = [np.array(c.encode(t), "<i4").tobytes() for t in batch.column("leaf").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("copies"), batch.column("k"), pa.array(ids, pa.binary())], ["doc_id", "mark", "copies", "k", "ids"])

    return run


def _trees(path: str):
    def run(got):
        import numpy as np
        import pyarrow as pa

        c = codec(path)
        got = got.sort_by("k")
        ids = merged([np.frombuffer(x, "<i4").tolist() for x in got.column("ids").to_pylist()], c.encode, c.bytes)
        n, a, b = c.digest_ids(ids)
        return pa.table({"doc_id": got.column("doc_id")[:1], "copies": got.column("copies")[:1], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    return run


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF, long_text: int = 4 * LEAF) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every whole text, by doc_id.

    Texts of up to long_text characters are encoded where they are read. Longer ones are halved into leaves, which are
    dealt out over the cluster and encoded in parallel; each text's leaves then meet in one task, where neighbours are
    joined pairwise up the tree (joined). A null text counts as empty and has no tokens; repeated rows stay as often as
    they are; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    shape = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = texts.filter(F.length("text") <= long_text).mapInArrow(_digests(path), shape)
    long = texts.filter(F.length("text") > long_text).withColumn("mark", F.md5("text")).groupBy("doc_id", "mark").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    steps = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf).cast("int"))
    dealt = long.select("doc_id", "mark", "copies", "text", F.explode(steps).alias("k")).select(
        "doc_id", "mark", "copies", "k", F.expr(f"substring(text, k * {leaf} + 1, {leaf})").alias("leaf")
    )
    dealt = dealt.repartition("doc_id", "mark", "k").mapInArrow(_leaves(path), f"doc_id {kind}, mark string, copies long, k int, ids binary")
    trees = dealt.groupBy("doc_id", "mark").applyInArrow(_trees(path), f"doc_id {kind}, copies long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    again = trees.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    return short.unionByName(again)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_query(spark, sf_dir):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
