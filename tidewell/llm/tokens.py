"""Tokenizers read from a file, exact to the library and safe to run on fragments of a text.

A `Tokenizer` is built on each worker from the file's content, which the driver sends; its path need
not exist on the workers. Where the file describes a byte-pair encoding whose pieces a rank table can
express, the ranks run in `tiktoken`, which is several times faster than the `tokenizers` library and
gives the same ids; texts with characters outside `PLAIN`, for which the two libraries' Unicode tables
might differ, always go to the library itself.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from tidewell.llm.common import process_store

#: Characters on whose classes all Unicode versions agree: Latin, Greek and Cyrillic letters, general
#: punctuation, kana, common CJK ideographs and Hangul syllables.
PLAIN = "\x01-ɏΑ-ΡΣ-Ωα-ωА-я‐-‧€ぁ-ゖァ-ヺ一-龥가-힣"
_OTHER = re.compile(f"[^{PLAIN}]")
#: The characters of `PLAIN` whose white space, lower case and number class are the same in Python and Arrow, too; the
#: canonical composition leaves texts of them as they are.
EASY = "\x01-\r -~¡-±´-¸º»¿-įı-ɏΑ-ΡΤ-Ωα-ωА-я‐-‧€ぁ-ゖァ-ヺ一-龥가-힣"
_HARD = re.compile(f"[^{EASY}]")
#: The split pattern of the byte-level pre-tokenizer (a fixed value of that format), with possessive runs.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The split pattern of the pre-tokenizer with word ends (a fixed value of that format).
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same classes in the syntax of `re`; used for texts of `EASY` characters only.
_WORD_END_RE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Words whose pieces a worker keeps at most, the first it meets. It keeps them for life, beside whatever it runs later, and
#: a corpus has ever more words that occur once.
CACHE_WORDS = 1 << 17


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def inside_pairs(tokens: list[bytes]) -> np.ndarray:
    """Which byte pairs occur inside some token: a 256 by 256 table of booleans.

    A pair that occurs in none marks a certain cut: no merge can ever join its two bytes.
    """
    table = np.zeros((256, 256), dtype=bool)
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    pairs = np.ones(max(0, len(data) - 1), dtype=bool)
    pairs[ends[ends < len(data)] - 1] = False
    table[data[:-1][pairs], data[1:][pairs]] = True
    return table


class Tokenizer:
    """Exact encoding, decoding and certain cuts of one byte-level tokenizer file."""

    def __init__(self, content: str):
        self.content = content
        spec = json.loads(content)
        model, self.alphabet = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        try:
            self.tokens = {i: self._bytes(t) for t, i in self.vocab.items()}
        except KeyError:
            raise ValueError("not a byte-level vocabulary") from None
        contents = [t.encode() for t in self.special]
        inside = inside_pairs([t for t in [*self.tokens.values(), *contents] if t])
        # Besides, the pre-tokenizer must break there in any text: between a printable ASCII
        # character and white space no alternative of either pattern can go on.
        left = np.zeros(256, dtype=bool)
        left[33:127] = True
        right = np.zeros(256, dtype=bool)
        right[[9, 10, 11, 12, 13, 32]] = True
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
        self.certain = ~inside & left[:, None] & right[None, :]
        if not (plain and self._splits(spec)):
            self.certain[:] = False

    @cached_property
    def library(self):
        """The library's own tokenizer, which only a few texts need."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer as Library

        library = Library.from_str(self.content)
        library.no_truncation()
        library.no_padding()
        return library

    @cached_property
    def ranks(self):
        """The merges as ranks; None if they can't be expressed so. Not built where ids are only decoded."""
        spec = json.loads(self.content)
        return self._rank_table(spec, spec["model"])

    def _bytes(self, token: str) -> bytes:
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        return bytes(self.alphabet[c] for c in body) + (b" " if end else b"")

    def _splits(self, spec: dict) -> bool:
        """Whether the pre-tokenizer is one of the two whose breaks are known."""
        parts = [spec.get("pre_tokenizer") or {}]
        parts = parts[0].get("pretokenizers", parts)
        if spec["model"].get("type") != "BPE" or spec.get("post_processor"):
            return False
        if self.suffix:
            first = parts[0].get("pattern", {}).get("Regex") == WORD_END and parts[0].get("behavior") == "Removed"
            steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
            return len(parts) == 2 and first and steps == ["NFC", "Replace", "Lowercase"]
        level = parts[0]
        own = level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space")
        return len(parts) == 1 and bool(own) and not spec.get("normalizer")

    def _rank_table(self, spec: dict, model: dict):
        """The merges as ranks of byte strings, or None if a rank table can't express them."""
        import tiktoken

        if not self._splits(spec) or model.get("dropout") or model.get("byte_fallback"):
            return None
        merged = [self._bytes("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        singles = [bytes([b]) for b in range(256)]
        # A word end is a blank: its last byte and the blank form the first merges of all.
        ends = [s + b" " for s in singles] if self.suffix else []
        order = [*singles, *ends, *merged]
        ids = {t: i for i, t in self.tokens.items()}
        if len(set(order)) != len(order) or set(order) != set(ids):
            return None
        self.by_rank = np.array([ids[t] for t in order] + list(self.special.values()), dtype=np.uint32)
        self.rank_ends = np.array([t.endswith(b" ") for t in order])
        special = {} if self.suffix else {t: len(order) + i for i, t in enumerate(self.special)}
        pattern = r"[^ ]+ " if self.suffix else BYTE_LEVEL
        return tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens=special
        )

    def cuts(self, data: bytes, least: int) -> list[int]:
        """Certain cuts of a text, each at least `least` bytes after the one before; 0 and the end included."""
        if len(data) <= least:
            return [0, len(data)]
        view = np.frombuffer(data, dtype=np.uint8)
        found = np.flatnonzero(self.certain[view[:-1], view[1:]]) + 1
        cuts, at = [0], least
        while (i := int(np.searchsorted(found, at))) < len(found):
            cuts.append(int(found[i]))
            at = cuts[-1] + least
        return [*cuts, len(data)]

    def fragments(self, data: bytes, least: int) -> Iterator[str]:
        cuts = self.cuts(data, least)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield data[a:b].decode("utf-8", "replace")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text or fragment, as the library gives them without added special tokens."""
        if self._easy(text):
            return self._encode_words([text])[0]
        if self.ranks is None or self.suffix or _OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.by_rank[self.ranks.encode_to_numpy(text, allowed_special="all")]

    def _easy(self, text: str) -> bool:
        """Whether the vocabulary has word ends and the text is encoded word by word."""
        return bool(self.suffix) and self.ranks is not None and not (_HARD.search(text) or any(t in text for t in self.special))

    def encode_batch(self, texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, and the number of each text's ids."""
        shown = [x.decode("utf-8", "replace") for x in texts]
        easy = np.array([self._easy(x) for x in shown], dtype=bool)
        if easy.all() and len(texts):
            return self._encode_words(shown)
        found = [np.zeros(0, dtype=np.uint32)] * len(texts)
        if easy.any():
            at = np.flatnonzero(easy)
            ids, sizes = self._encode_words([shown[i] for i in at])
            for i, own in zip(at, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                found[i] = own
        for i in np.flatnonzero(~easy):
            found[i] = self.encode_parts(texts[i], least)
        return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), np.array(list(map(len, found)), dtype=np.int64)

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`encode_batch` for easy texts: each distinct word of the batch is looked up once, and laid where it occurs."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        words = split.values.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = process_store().setdefault(("words", self.digest), {})
        pieces = list(map(known.get, distinct))
        new = [i for i, found in enumerate(pieces) if found is None]
        for i, found in zip(new, self._pieces([distinct[i] for i in new]), strict=True):
            pieces[i] = found
            if len(known) < CACHE_WORDS:
                known[distinct[i]] = found
        table = np.frombuffer(b"".join(pieces), dtype=np.uint32)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        place = words.indices.to_numpy()
        counts = size[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((np.cumsum(size) - size)[place] - ends[:-1], counts) + np.arange(ends[-1])
        return table[at], np.diff(ends[split.offsets.to_numpy()])

    def _pieces(self, words: list[str]) -> list[bytes]:
        """The ids, as bytes, of each lower-case word, from one run over all of them."""
        spaced = [f"{w} " if w.isalpha() else "".join([f"{x} " for x in _WORD_END_RE.findall(w)]) for w in words]
        parts = [x.count(" ") for x in spaced]
        ranks = self.ranks.encode_to_numpy("".join(spaced)) if any(parts) else np.zeros(0, dtype=np.uint32)
        # Every part ends with the one token of its own that ends with a blank.
        ends = np.concatenate([[0], np.flatnonzero(self.rank_ends[ranks]) + 1])
        cuts = 4 * ends[np.cumsum([0, *parts])]
        data = self.by_rank[ranks].tobytes()
        return [data[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def lengths(self, texts: list[str]) -> list[int]:
        """Numbers of ids of a batch of texts or fragments."""
        return [len(self.encode(t)) for t in texts]

    def encode_parts(self, data: bytes, least: int) -> np.ndarray:
        """Ids of a whole text: fragments between certain cuts, encoded one by one and joined."""
        parts = [self.encode(f) for f in self.fragments(data, least)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD.

        For vocabularies with word ends, the words are joined by blanks.
        """
        table = getattr(self, "_table", None)
        if table is None:
            table = [b""] * self.size
            for i, t in self.tokens.items():
                table[i] = t
            for t, i in self.special.items():
                table[i] = t.encode() + (b" " if self.suffix else b"")
            self._table = table
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


class Source:
    """A tokenizer file, sent to the workers once; its size is bounded by `LIMIT`."""

    LIMIT = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        content = Path(path).read_text(encoding="utf-8")
        if len(content) > self.LIMIT:
            raise ValueError(f"{path} is larger than {self.LIMIT} characters")
        self.digest = hashlib.sha256(content.encode()).hexdigest()
        self.content: Broadcast[str] = spark.sparkContext.broadcast(content)

    def get(self) -> Tokenizer:
        """The tokenizer, built once in a worker's life."""
        store = process_store()
        key = ("tokenizer", self.digest)
        if key not in store:
            store[key] = Tokenizer(self.content.value)
            store[key].digest = self.digest
        return store[key]
