"""Exact token counts at every prefix, by dynamic programming.

Byte-pair encoding has the property that of all tokens that end at a byte
exactly one can close the encoding of the prefix up to there: the one that is
compatible with the token that closes the prefix before it. So one pass over a
piece gives the last token and the count of every prefix
(``count[i] = count[i - len(token)] + 1``), and the stored counts answer how
many tokens any prefix has (``tokens_at``) and where a budget ends
(``truncate_to_budget``) without encoding a text again.

Two tokens are compatible if no merge of the vocabulary crosses their border
while both sides are built, which their merge trees' facing edges tell.

A prefix counts as a text of its own. Where its end changes the split into pieces
(in white space before a word, in a contraction, in a special token) its count is
the one of its own split. A prefix that ends inside a character counts the bytes
it has as part of the piece that the character belongs to.

Counts are stored as steps, one number for each byte of the text: twice the count
up to and with this byte less the count before it, plus one where the byte does
not end a character. They take one byte each, or two each in a text with a step
that needs them; ``n_bytes`` tells which.

Defined results: a null or empty text has no tokens; strings of special tokens
inside a text count as the library counts them by default (one token each).
Repeated rows give repeated rows; columns other than the id and the text are not
read.
"""

from __future__ import annotations

import array
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import CACHE_BYTES, Cache, tokenizer_path, worker_local
from .words import text_slices

#: The byte-level tokenizer's own split into pieces. Fixed value of the format.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens that a worker keeps judged.
MOST_PAIRS = 200_000
#: Pieces that their own prefix of two bytes is not: that one is an apostrophe and a letter.
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
#: Bytes of white space and of signs that libraries disagree on, other than blanks and line feeds, or a NUL.
ODD_BYTES = re.compile(rb"[\0\t\x0b-\x0d\x1c-\x1f]")
#: First bytes of white space outside ASCII, with what follows.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf")


def even(text: bytes) -> bool:
    """Whether single blanks and line feeds alone stand between the words."""
    return not (b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or text[:1].isspace() or text[-1:].isspace() or ODD_BYTES.search(text))


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class PrefixCounter:
    """Token counts of every prefix of a piece, under one byte-level vocabulary."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[self.ids[a], self.ids[b]] = r
            self.parts.setdefault(self.ids[a + b], (r, self.ids[a], self.ids[b]))
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(PIECE)
        self.space = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.steps = Cache(cache_bytes)
        self.feed = self.prefix_counts("\n")[-1]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on one edge of a token's merge tree (0: right, 1: left), each with the rank at which it is merged away."""
        known = self.edges[side].get(token)
        if known is None:
            known, until = [], 1 << 60
            at = token
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                until, left, right = self.parts[at]
                at = left if side else right
            self.edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes together is a, b."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            rank = self.rank.get
            known = True
            for x, until_x in self.edge(a, 0):
                for y, until_y in self.edge(b, 1):
                    r = rank((x, y))
                    # equal ranks: the merge further left is made first
                    if r is not None and r < until_x and r <= until_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.fits) < MOST_PAIRS:
                self.fits[a << 32 | b] = known
        return known

    def prefix_counts(self, piece: str) -> list[int]:
        """Tokens of each byte prefix of one piece; the last one is the piece's count."""
        data, (last, count) = piece.encode("utf-8"), ([-1], [0])
        self.extend(data, last, count)
        return count

    def extend(self, data: bytes, last: list[int], count: list[int]) -> None:
        """Go on from the prefixes of ``data`` that ``last`` (token that closes each) and ``count`` have already."""
        ids, longest, compatible = self.ids, self.longest, self.compatible
        for i in range(len(last), len(data) + 1):
            for start in range(max(0, i - longest), i):
                token = ids.get(data[start:i])
                if token is not None and (start == 0 or compatible(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("no token closes this prefix")

    def piece_steps(self, pieces: set[str]) -> dict[str, bytes]:
        """What each byte of many pieces adds to the count, as 16-bit numbers. In sorted order each piece shares a prefix with the one before, whose counts stand already."""
        found, last, count, steps, before = {}, [-1], [0], array.array("h"), b""
        for piece in sorted(pieces):
            data = piece.encode("utf-8")
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :], steps[same:]
            self.extend(data, last, count)
            steps.extend([b - a for a, b in zip(count[same:], count[same + 1 :])])
            found[piece] = array.array("h", (1, 1, count[-1] - 2)).tobytes() if piece in CONTRACTIONS else steps.tobytes()
            before = data
        return found

    def word_steps(self, words: list[str]) -> list[bytes]:
        """Steps of words, each of which is a whole number of pieces without white space but for one blank before it."""
        cut = list(map(self.split.findall, words))
        found = self.piece_steps(set().union(*cut))
        return [found[own[0]] if len(own) == 1 else b"".join(map(found.__getitem__, own)) for own in cut]

    def text_steps(self, texts: list[str]) -> list:
        """Steps of each whole text, whatever white space and special tokens it has."""
        import numpy as np

        cut, wanted = [], set()
        for text in texts:
            parts, at = [], 0
            for own in self.special.finditer(text) if self.special else ():
                # up to its last byte a special token is plain text
                parts.append((self.split.findall(text[at : own.end()]), len(own[0].encode("utf-8"))))
                at = own.end()
            parts.append((self.split.findall(text[at:]), 0))
            cut.append(parts)
            for pieces, _ in parts:
                wanted.update(pieces)
                wanted.update(a + b[0] for a, b in zip(pieces, pieces[1:]) if b[0] in self.space and a[-1] in self.space)
        found = self.piece_steps(wanted)
        out = []
        for parts in cut:
            steps = [np.empty(0, dtype=np.int64)]
            for pieces, special in parts:
                whole = np.cumsum(np.frombuffer(b"".join(map(found.__getitem__, pieces)), dtype=np.int16), dtype=np.int64)
                counts, at = whole.copy(), 0
                for a, b in zip(pieces, pieces[1:]):
                    if b[0] in self.space and a[-1] in self.space:
                        # white space gives its last sign to what follows, but a prefix that ends there keeps it
                        own = np.frombuffer(found[a + b[0]], dtype=np.int16)
                        counts[at + len(own) - 1] = (whole[at - 1] if at else 0) + own.sum()
                    at += len(found[a]) // 2
                if special:
                    counts[-1] = (counts[-1 - special] if len(counts) > special else 0) + 1
                steps.append(np.diff(counts, prepend=0))
            out.append(np.concatenate(steps))
        return out

    def prefix_steps(self, texts: list[bytes | None]):
        """Tokens of each whole text, and its stored steps.

        Where single blanks and line feeds alone stand between words, a word with
        the blank before it and the full stop or comma after its last letter are
        whole pieces, and so is a line feed: the prefixes of each distinct word are
        counted once.
        """
        import numpy as np

        from .words import PAD, distinct, keys, part_tail, words_of

        texts = [t or b"" for t in texts]
        odd = [i for i, t in enumerate(texts) if not (even(t) and (t.isascii() or not WIDE_SPACE.search(t)) and not (self.special and self.special.search(t.decode("utf-8"))))]
        regular = list(texts)
        for i in odd:
            regular[i] = b""
        words = part_tail(words_of(regular))
        raw = np.frombuffer(words.data, dtype=np.uint8)[: -len(PAD)]
        steps = np.full(len(raw), self.feed, dtype=np.int64)
        if len(words.begin):
            # a word stands with the blank before it, if there is one
            words = words._replace(begin=words.begin - (raw[words.begin - 1] == 0x20))
            _, where, which = distinct(*keys(words))
            chunks = [words.data[a:b] for a, b in zip(words.begin[where].tolist(), words.end[where].tolist())]
            own = self.steps.results(chunks, lambda new: self.word_steps([c.decode("utf-8") for c in new]))
            # words with their blanks are all that is no line feed
            steps[raw != 0x0A] = np.frombuffer(b"".join(map(own.__getitem__, which.tolist())), dtype=np.int16)
        totals, stored, at = np.zeros(len(texts), dtype=np.int64), [], 1
        special = dict(zip(odd, self.text_steps([texts[i].decode("utf-8") for i in odd])))
        inside = np.append((raw[1:] & 0xC0) == 0x80, False)
        coded, sums = 2 * steps + inside, np.concatenate([[0], np.cumsum(steps)])
        narrow = coded.astype(np.int8)
        fits, packed = np.array_equal(narrow, coded), narrow.tobytes()
        for i, t in enumerate(texts):
            if i in special:
                own = special[i]
                totals[i] = own.sum()
                follows = np.append(np.frombuffer(t, dtype=np.uint8)[1:], np.zeros(min(len(t), 1), dtype=np.uint8))
                stored.append(_packed(2 * own + ((follows & 0xC0) == 0x80)))
            else:
                end = at + len(t)
                totals[i] = sums[end] - sums[at]
                stored.append(packed[at:end] if fits else _packed(coded[at:end]))
            at += len(regular[i]) + 1
        return totals, stored


def _packed(coded) -> bytes:
    """Numbers in one byte each, or in two each where one of them needs these."""
    import numpy as np

    narrow = coded.astype(np.int8)
    return narrow.tobytes() if np.array_equal(narrow, coded) else coded.astype("<i2").tobytes()


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a vocabulary."""
    return worker_local(("prefix counter", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, store_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    With ``store_prefixes`` also ``steps``: the tokens of every prefix, stored as
    the module's text says.
    """
    schema = "doc_id long, n_bytes long, n_tokens long" + ", steps binary" * store_prefixes

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        own = counter(tokenizer)
        for batch, texts in text_slices(batches):
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            totals, stored = own.prefix_steps(texts)
            arrays, names = [batch.column("doc_id"), size, pa.array(totals, type=pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            if store_prefixes:
                arrays.append(pa.array(stored, type=pa.binary()))
                names.append("steps")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    out = rows.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", *(["steps"] if store_prefixes else []))


def _from_steps(counted: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """doc_id and what ``answer`` makes of each row's stored numbers."""

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for size, steps in zip(batch.column("n_bytes").to_pylist(), batch.column("steps").to_pylist()):
                rows.append(answer(np.frombuffer(steps, dtype=np.int8 if len(steps) == size else "<i2").astype(np.int64)))
            columns = [pa.array(c, type=pa.int64()) for c in np.array(rows, dtype=np.int64).reshape(len(rows), -1).T]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return counted.select("doc_id", "n_bytes", "steps").mapInArrow(read, schema)


def tokens_at(counted: DataFrame, n_bytes: int) -> DataFrame:
    """doc_id and the tokens of the first ``n_bytes`` bytes (or of the whole text, where it is shorter), from stored counts alone."""
    return _from_steps(counted, lambda coded: [int((coded[: max(n_bytes, 0)] >> 1).sum())], "doc_id long, n_tokens long")


def truncate_to_budget(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, the bytes of the longest prefix of whole characters of at most ``budget`` tokens, and its tokens, from stored counts alone."""

    def longest(coded) -> list[int]:
        counts = (coded >> 1).cumsum()
        fit = ((counts <= budget) & (coded & 1 == 0)).nonzero()[0]
        return [int(fit[-1]) + 1, int(counts[fit[-1]])] if len(fit) else [0, 0]

    return _from_steps(counted, longest, "doc_id long, keep_bytes long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``, with the counts of all prefixes."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"), store_prefixes=True)
