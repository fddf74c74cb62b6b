"""Token ids of whole texts by a public byte-level BPE, and their decoding."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies, and the file within it; both are parameters everywhere.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that a leaf of the tree holds, and that a boundary window first has on each side.
LEAF, WINDOW = 16_384, 64
#: Tokens in one batch that goes back to Spark.
BATCH_TOKENS = 4 << 20

#: Where the pattern is bound to part the text, whatever stands around: after a letter, digit or
#: mark comes a blank or line feed; after a letter or digit of a long settled script comes a mark.
#: No alternative of the pattern runs over such a place, and none looks behind.
_SETTLED = r"A-Za-z0-9À-ÖØ-öø-ɏΑ-ΡΣ-ωА-яא-תء-غऄ-हก-ฮぁ-ゖァ-ヺ一-龥가-힣ሀ-ቈ"
_SURE = rf"(?<=[{_SETTLED}!-/:-@\[-`{{-~。、，])(?=[ \n])|(?<=[{_SETTLED}])(?=[!-/:-@\[-`{{-~。、，])"


class Codec:
    """A vocabulary, with encoding as a tree: halves are encoded by themselves, then joined."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self._bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self._bytes[rank] = len(word)
        self._words = {rank: word for word, rank in ranks.items()}
        self._sure = regex.compile(_SURE)
        self._leaf, self._window = leaf, window
        self.size = len(self._bytes)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self._leaf:
            return np.array(self._bpe.encode_ordinary(text), np.int32)
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self._leaf:
            return np.array(self._bpe.encode_ordinary(text[start:end]), np.int32)
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[start:end] from those of its halves: only a window around middle is encoded again.

        The window grows until each side ends where the pattern parts the text for sure, so the
        tokens outside are those of the whole; without such a place a half is taken in full.
        """
        low, high = start, end
        reach = self._window
        while middle - reach > start:
            at = None
            for found in self._sure.finditer(text, max(start + 1, middle - 2 * reach), middle - reach + 1):
                at = found.start()
            if at is not None:
                low = at
                break
            reach *= 2
        reach = self._window
        while middle + reach < end:
            found = self._sure.search(text, middle + reach, min(end, middle + 2 * reach + 1))
            if found and found.start() < end:
                high = found.start()
                break
            reach *= 2
        inner = np.array(self._bpe.encode_ordinary(text[low:high]), np.int32)
        return np.concatenate([self._before(left, len(text[start:low].encode())), inner, self._after(right, len(text[high:end].encode()))])

    def _before(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        return ids[: np.searchsorted(np.cumsum(self._bytes[ids]), n_bytes, "left") + 1] if n_bytes else ids[:0]

    def _after(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        ends = np.cumsum(self._bytes[ids][::-1])
        return ids[len(ids) - int(np.searchsorted(ends, n_bytes, "left")) - 1 :] if n_bytes else ids[:0]

    def decode(self, ids: np.ndarray) -> str:
        return self._decode(ids).decode("utf-8", "replace")

    def _decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the halves are put together up the tree, as a character may lie across both."""
        if len(ids) <= self._leaf:
            return self._bpe.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self._decode(ids[:middle]) + self._decode(ids[middle:])


@functools.lru_cache(4)
def codec(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Codec:
    return Codec(os.path.join(folder, vocabulary))


def encoded(batch: pa.RecordBatch, text: str, folder: str, vocabulary: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of a batch's rows, each with its first row and the ids of its texts."""
    code, start, part, tokens = codec(folder, vocabulary), 0, [], 0
    column = batch.column(text)
    for k in range(batch.num_rows):
        value = column[k].as_py()
        part.append(code.encode(value) if value else np.zeros(0, np.int32))
        tokens += len(part[-1])
        if tokens >= BATCH_TOKENS:
            yield start, part
            start, part, tokens = k + 1, [], 0
    if part:
        yield start, part


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array<int>) of every row of documents, by a public vocabulary.

    Special tokens are neither added nor recognised: their strings are ordinary text. Null and
    empty texts have an empty list; a null doc_id stays null; repeated rows come out repeated;
    other columns are ignored. No shuffle; a text is encoded within its task. A long one is encoded as a
    tree of leaves of LEAF characters, which gives the ids of the whole text. The windows cost little, so
    it takes about as long as plain encoding; in a text in which no place parts for sure (no blank or mark
    after a letter) the windows grow to the halves, and each of its log2(length / LEAF) levels costs as much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in encoded(batch, "text", folder, vocabulary):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_texts(encodings: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows doc_id, ids. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(folder, vocabulary)
        for batch in batches:
            ids = batch.column("ids")
            texts = [code.decode(ids[k].values.to_numpy(zero_copy_only=False)) if ids[k].is_valid and len(ids[k]) else "" for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
