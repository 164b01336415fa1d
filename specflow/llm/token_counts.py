"""Token counts of whole documents, huge ones by overlapping chunks.

A text of at most ``chunk`` characters is encoded at once. A longer text, as over a third of usual documents are, is encoded as
chunks of that many characters that overlap, each with the offsets of its tokens. Two neighbours are spliced at a boundary that both prove stable: the end of a pre-token (a match of the
tokenizer's split pattern) that both chunks have at the same place. The left chunk's pre-tokens are those of the whole
text except where they touch its right edge, so a margin there is not used; the split pattern never looks back, so from a
common end of a pre-token on the right chunk's are those of the whole text too. Merges never leave a pre-token, so the
tokens left of that place are the left chunk's and those right of it the right chunk's. Where the overlap holds no such
place (one word longer than the overlap, say) it is widened, doubling up to the whole text.

A SentencePiece model splits nothing before merging that could prove a boundary stable; its texts are encoded whole.
Null texts count as empty; an empty text has 0 tokens and one chunk. One row comes back for each row, repeated rows included.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 2048, 128
#: Characters before a chunk's right edge at which no splice is made, at least; it is more than the tokenizer's longest added token, so that
#: one which the edge cuts begins after the splice. The overlap is ``OVERLAPS`` margins at least, a chunk as many overlaps.
MARGIN, OVERLAPS = 32, 4


class Counter:
    """Counts tokens with one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.chunks = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
            return
        from .hf import open_tokenizer, splits_at_space

        self.tokenizer = open_tokenizer(path)
        self.chunks = splits_at_space(self.tokenizer)  # only where pre-tokens are known to be independent
        longest = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self.margin = max(MARGIN, longest + 1)
        self.overlap = max(overlap, OVERLAPS * self.margin if self.margin > MARGIN else 0)
        self.chunk = max(chunk, OVERLAPS * self.overlap if self.margin > MARGIN else 0)
        self.whole = lambda texts: [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str, chunk: int, overlap: int) -> Counter:
        return Counter(path, chunk, overlap)

    def encoded(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    @staticmethod
    def word_end(e, char: int) -> tuple[int, int, int] | None:
        """Of the pre-token that holds a character: where it begins and ends, and how many tokens there are up to its end; None for white
        space that its offsets leave out, and for special strings."""
        word = e.char_to_word(char)
        if word is None:
            return None
        chars = e.word_to_chars(word)
        return chars[0], chars[1], e.word_to_tokens(word)[1]

    def common(self, left, begin: int, low: int, high: int, right, right_begin: int) -> tuple[int, int, int] | None:
        """The last place in (low, high] at which pre-tokens of both chunks end, and the tokens that each has before it."""
        at = high - 1
        while at >= low:
            found = self.word_end(left, at - begin)
            if found is None:
                at -= 1
                continue
            place = begin + found[1]
            if low < place <= high and (other := self.word_end(right, place - 1 - right_begin)) and right_begin + other[1] == place:
                return place, found[2], other[2]
            at = min(at, begin + found[0]) - 1
        return None

    def long(self, text: str) -> tuple[int, int]:
        """Tokens of a text longer than a chunk, and the chunks that were spliced. Only the places that are tried are asked for: a chunk's
        offsets stay in the library."""
        begin, end = 0, min(len(text), self.chunk)
        e = self.encoded(text[begin:end])
        start = skipped = 0  # the place from which the present chunk counts, and its tokens before that
        total, chunks = 0, 1
        while end < len(text):
            overlap, found = self.overlap, None
            while True:
                right = max(start, end - overlap)
                right_end = min(len(text), right + self.chunk + overlap)
                e2 = self.encoded(text[right:right_end])
                if found := self.common(e, begin, right, end - self.margin, e2, right):
                    break
                self.widened += 1
                if right == start:  # the chunk cannot begin earlier: it must end later
                    end = min(len(text), end + 2 * overlap)
                    e = self.encoded(text[begin:end])
                    if end == len(text):
                        break
                overlap *= 2
            if not found:
                break
            start, before, after = found
            total, skipped, chunks = total + before - skipped, after, chunks + 1
            begin, end, e = right, right_end, e2
        return total + len(e) - skipped, chunks

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens and chunks of each text."""
        huge = [self.chunks and len(t) > self.chunk for t in texts]
        short = iter(self.whole([t for t, h in zip(texts, huge, strict=True) if not h]))
        return [self.long(t) if h else (next(short), 1) for t, h in zip(texts, huge, strict=True)]


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Key, n_bytes, n_tokens, whether there are more than ``limit`` tokens, and n_chunks, the chunks that were spliced, for each
    row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def batches(stream):
        counter = Counter.of(path, chunk, overlap)
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [x for a, b in slices(texts) for x in counter.count(texts[a:b])]
            n, chunks = [x[0] for x in found], [x[1] for x in found]
            columns = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chunks, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint")
