"""BPE encoding and decoding by batched merge rounds over a flat array of symbols.

The words of many texts are made distinct, and the symbols of the distinct words lie in
one flat array. Every round looks up the ranks of neighbouring symbols by binary search
over the sorted pair keys, takes the lowest rank of each word, and joins the pairs that
have it. Words without a pair to join leave the array. Texts gather the ids of their
words at the end of a chunk, so no text meets the merges twice for one word.

One round a rank is exact where no merge has a part that a later merge makes, which is
checked when a vocabulary is loaded: joining a pair can then only bring forth pairs of
higher rank.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from perigee.llm.shared import column, map_batches, texts

# words whose symbols are merged together, and characters that are split at once
CHUNK_WORDS = 1 << 18
CHUNK_CHARS = 1 << 20
NO_PAIR = np.iinfo(np.int64).max
IDS, BYTES = "array<int>", "binary"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others take letters from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    """Merges as sorted pair keys, and how texts are normalised and cut into words."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain BPE with word ends is supported")
        if spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("post-processors and decoders are not supported")
        ids, ending = model["vocab"], model.get("end_of_word_suffix") or ""
        self.steps = [_step(x) for x in _sequence(spec["normalizer"], "normalizers")]
        cut, level = _sequence(spec["pre_tokenizer"], "pretokenizers")
        if (cut["type"], cut["behavior"], cut["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != (
            ("Split", "Removed", True, "ByteLevel", False, False)
        ):
            raise ValueError("words have to be the matches of one pattern, in byte letters")
        self.word = cut["pattern"]["Regex"]
        empty = {"type": "BPE", "vocab": {}, "merges": []}
        self.rules = json.dumps(spec | {"model": empty, "added_tokens": [], "pre_tokenizer": cut})
        self.special = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("added tokens have to match as they are")
            self.special[token["content"]] = token["id"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + ending] for x in letters], np.int64)
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * self.size
        for token, number in [*ids.items(), *self.special.items()]:
            self.tokens[number] = token.encode()
        self._merges([pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]], ids)

    def _merges(self, merges: list, ids: dict[str, int]) -> None:
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[self.made] = np.arange(len(merges))
        if len(np.unique(self.made)) != len(merges) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge has a part that a later merge makes: rounds by rank are not exact")
        keys = left * self.size + right
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The vocabulary of a tokenizer file, read on the driver."""
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, by binary search; NO_PAIR where none is."""
        if not len(self.keys):
            return np.full(len(left), NO_PAIR)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_PAIR)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of the words one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.inner[raw]
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = self._ranks(symbols, owner)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = lowest == NO_PAIR
            if over.any():
                done.append((owner[over], symbols[over]))
                symbols, owner, rank, lowest = (x[~over] for x in (symbols, owner, rank, lowest))
            symbols, owner, rank = self._round(symbols, owner, rank, lowest)
        owners = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in done]])
        ids = np.concatenate([np.zeros(0, np.int64), *[x for _, x in done]])
        return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of every symbol with the next one of its word."""
        rank = np.full(len(symbols), NO_PAIR)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return rank

    def _round(self, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, lowest: np.ndarray) -> tuple:
        """Join the pairs of each word's lowest rank, from the left and without overlap."""
        hits = np.flatnonzero(rank == lowest)
        if not len(hits):
            return symbols, owner, rank
        # neighbouring hits are a run of one symbol: every other one of them holds
        new_run = np.concatenate(([True], np.diff(hits) != 1))
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
        symbols = symbols.copy()
        symbols[hits] = self.made[rank[hits]]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        place = np.cumsum(keep) - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        at = place[hits]
        changed = np.zeros(len(symbols), bool)
        changed[at] = changed[at[at > 0] - 1] = True
        touched = np.flatnonzero(changed)
        followed = touched[touched + 1 < len(symbols)]
        followed = followed[owner[followed] == owner[followed + 1]]
        rank[touched] = NO_PAIR
        rank[followed] = self.rank(symbols[followed], symbols[followed + 1])
        return symbols, owner, rank

    def normalised(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with a space between any two, as there is no decoder."""
        return b" ".join([self.tokens[i] for i in ids.tolist()])


def _sequence(part: dict, name: str) -> list[dict]:
    return part[name] if part["type"] == "Sequence" else [part]


class _Replace:
    def __init__(self, pattern: str, content: str) -> None:
        self.pattern, self.content = regex.compile(pattern), content.replace("\\", r"\\")

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self.content, text)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def lowercase(text: str) -> str:
    """Character by character: a sigma at the end of a word is a sigma like any other."""
    return text.replace("Σ", "σ").lower()


def _step(part: dict) -> Callable[[str], str]:
    if part["type"] == "NFC":
        return nfc
    if part["type"] == "Lowercase":
        return lowercase
    if part["type"] == "Replace":
        return _Replace(part["pattern"]["Regex"], part["content"])
    raise ValueError(f"normalizer {part['type']} is not supported")


class Encoder:
    """Encodes the texts of a batch, a chunk of words at a time."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.word = regex.compile(vocabulary.word)
        self.library: Tokenizer | None = None
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in lists of bounded size; an added token is a word."""
        parts = self.special.split(text) if self.special else [text]
        for odd, part in enumerate(parts):
            if odd % 2:
                yield [part]
                continue
            if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in set(part)):
                yield self._by_library(part)
                continue
            part, at = self.vocabulary.normalised(part), 0
            while at < len(part):
                # words hold no space, so a cut at one parts none
                cut = part.find(" ", at + CHUNK_CHARS) if len(part) - at > CHUNK_CHARS else -1
                cut = len(part) if cut < 0 else cut
                yield self.word.findall(part, at, cut)
                at = cut

    def _by_library(self, text: str) -> list[str]:
        """The words of a text with characters that are newer than Python's Unicode: only
        the tokenizers library tells what it takes them for."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.vocabulary.rules)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, batch: Iterator[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the texts, one after the other."""
        sizes, held, rows, chunks = [], [], [], []

        def flush() -> None:
            ids, counts = self._chunk(held)
            chunks.append(ids)
            row_ends = np.cumsum([n for _, n in rows])
            ends = np.concatenate(([0], np.cumsum(counts)))
            for (row, n), end in zip(rows, row_ends.tolist(), strict=True):
                sizes[row] += int(ends[end] - ends[end - n])
            held.clear(), rows.clear()

        for row, text in enumerate(batch):
            sizes.append(0)
            for words in self.words((text or b"").decode()):
                held.extend(words)
                rows.append((row, len(words)))
                if len(held) >= CHUNK_WORDS:
                    flush()
        if held:
            flush()
        return np.concatenate([np.zeros(0, np.int32), *chunks]), np.array(sizes, np.int64)

    def _chunk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words that may repeat: each distinct one is merged once."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # added tokens go behind the words that are merged
        added = [k for k, w in enumerate(distinct) if w in self.vocabulary.special]
        order = [*(k for k, w in enumerate(distinct) if w not in self.vocabulary.special), *added]
        ids, sizes = self.vocabulary.merged([distinct[k].encode() for k in order[: len(order) - len(added)]])
        ids = np.concatenate([ids, np.array([self.vocabulary.special[distinct[k]] for k in added], np.int64)])
        sizes = np.concatenate([sizes, np.ones(len(added), np.int64)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number, starts = place[number], np.cumsum(sizes) - sizes
        counts = sizes[number]
        shift = np.repeat(starts[number] - (np.cumsum(counts) - counts), counts)
        return ids[shift + np.arange(len(shift))].astype(np.int32), counts


def _passed(documents: DataFrame, made: tuple[str, ...]) -> tuple[list[str], str]:
    names = [x for x in documents.columns if x not in made]
    return names, "".join(f"`{x}` {documents.schema[x].dataType.simpleString()}, " for x in names)


def encode(documents: DataFrame, path: str, text_col: str = "text", ids_as: str = IDS) -> DataFrame:
    """`documents` with n_tokens and ids.

    `ids` is an array of ints or, with `ids_as` binary, the ids as little-endian unsigned
    32-bit integers, as token files hold them. A null text counts as empty; an empty text,
    and one without words, has no ids. Strings of added tokens in a text become their ids.
    Long texts are split and merged a chunk of words at a time. Rows may repeat; an input
    column with the name of an output column is replaced by it. An empty table stays empty.
    """
    vocabulary = Vocabulary.load(path)
    source = documents.withColumn("ids", documents[text_col]) if text_col in ("ids", "n_tokens") else documents
    read = "ids" if text_col in ("ids", "n_tokens") else text_col
    names, schema = _passed(documents, ("n_tokens", "ids"))

    def work(batch: pa.RecordBatch) -> dict:
        ids, sizes = Encoder(vocabulary).encode(texts(batch, read))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        if ids_as == IDS:
            value = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        else:
            raw = ids.astype("<u4")
            value = pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return {x: column(batch, x) for x in names} | {"n_tokens": pa.array(sizes), "ids": value}

    wanted = [*names, *([] if read in names else [read])]
    return map_batches(source.select(*[f"`{x}`" for x in wanted]), f"{schema}n_tokens bigint, ids {ids_as}", work)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded`: the tokens of its ids, arrays or bytes, joined by spaces.

    Null ids give null, no ids an empty text. An input column `decoded` is replaced.
    """
    vocabulary = Vocabulary.load(path)
    names, schema = _passed(encoded, ("decoded",))
    packed = encoded.schema[ids_col].dataType.simpleString() == BYTES

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for value in column(batch, ids_col):
            if not value.is_valid:
                out.append(None)
            elif packed:
                out.append(vocabulary.decode(np.frombuffer(value.as_buffer(), "<u4")))
            else:
                out.append(vocabulary.decode(value.values.to_numpy(zero_copy_only=False)))
        return {x: column(batch, x) for x in names} | {"decoded": pa.array(out, pa.binary()).view(pa.string())}

    return map_batches(encoded.select(*[f"`{x}`" for x in names]), f"{schema}decoded string", work)
