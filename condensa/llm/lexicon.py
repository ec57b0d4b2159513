"""Word-level BPE by a minimal acyclic transducer: frequent words with their ids in a shared-suffix automaton.

The words of the whole corpus are counted, the most frequent ones are merged into ids once, and their bytes are compiled
into a minimal acyclic automaton (built from the sorted words, equal suffixes shared). Each transition carries a number; the numbers on a word's
path add up to its place among the sorted words (as in a transducer with pushed weights), which leads to its ids. The automaton is
one flat file of integers in the shared folder, which every worker maps into memory. A batch's distinct words walk
it together, a byte a step; words that fall off it are merged exactly, by rank, leftmost first.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.bpe import byte_letters, vocabulary_path
from condensa.llm.shared import Scratch, fresh_dir, remove
from condensa.llm.tokenbin import filesystem

_END = "</w>"
#: Longer words are rare and aren't compiled; they are merged like other unseen ones.
_LONGEST = 48


class Automaton:
    """Arrays of a minimal acyclic transducer of byte strings.

    ``first[s]`` to ``first[s + 1]`` are the transitions of state s in ``label``, ``target`` and ``number``; ``final[s]`` tells
    whether a word ends there. The ids of word k are ``ids[offset[k]:offset[k + 1]]``.
    """

    PARTS = ("first", "label", "target", "number", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.first, self.label, self.target, self.number, self.final, self.offset, self.ids = (arrays[k] for k in self.PARTS)
        # (state, byte) of each transition in one number, ascending: a step is a binary search
        states = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        self.keys = states * 256 + self.label

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Automaton:
        """From words in ascending order and their ids."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def close(node: list) -> int:
            """The state of a finished node [final, {byte: node or state}]: an equal one if there is one."""
            found = (node[0], tuple(node[1].items()))
            if found not in register:
                register[found] = len(states)
                states.append(found)
            return register[found]

        path, last = [[False, {}]], b""  # open nodes along the last word
        for word in [*words, None]:
            shared = 0 if word is None else len(os.path.commonprefix([word, last]))
            while len(path) > shared + 1:
                state = close(path.pop())
                path[-1][1][last[len(path) - 1]] = state
            if word is not None:
                for byte in word[shared:]:
                    node: list = [False, {}]
                    path[-1][1][byte] = node
                    path.append(node)
                path[-1][0], last = True, word
        root = close(path[0])
        # the root comes first; words below each state give the numbers of its transitions
        order = [root, *(s for s in range(len(states)) if s != root)]
        name = {s: k for k, s in enumerate(order)}
        below = [0] * len(states)
        for s, (final, arcs) in enumerate(states):  # targets are closed before their sources
            below[s] = final + sum(below[t] for _, t in arcs)
        first, label, target, number = [0], [], [], []
        for s in order:
            final, arcs = states[s]
            skipped = int(final)
            for byte, t in arcs:
                label.append(byte)
                target.append(name[t])
                number.append(skipped)
                skipped += below[t]
            first.append(len(label))
        flat = [i for own in ids for i in own]
        return cls({
            "first": np.array(first, "<i4"), "label": np.array(label, "<i4"), "target": np.array(target, "<i4"), "number": np.array(number, "<i4"),
            "final": np.array([states[s][0] for s in order], "<i4"), "offset": np.cumsum([0, *map(len, ids)]).astype("<i4"), "ids": np.array(flat, "<i4"),
        })

    def save(self, uri: str) -> None:
        """One file: the sizes of the parts, then the parts, all as 32-bit integers."""
        store, path = filesystem(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        parts = [getattr(self, k) for k in self.PARTS]
        with store.open_output_stream(path) as out:
            out.write(np.array([len(p) for p in parts], "<i4").tobytes() + b"".join(p.tobytes() for p in parts))

    @classmethod
    def load(cls, uri: str) -> Automaton:
        """Mapped where the file is at a local path, else read whole (its size is bounded by the number of words)."""
        store, path = filesystem(uri)
        if os.path.exists(path):
            flat = np.memmap(path, "<i4", mode="r")
        else:
            with store.open_input_file(path) as file:
                flat = np.frombuffer(file.read(), "<i4")
        cuts = np.cumsum([len(cls.PARTS), *flat[: len(cls.PARTS)].tolist()])
        return cls({k: flat[a:b] for k, a, b in zip(cls.PARTS, cuts, cuts[1:], strict=False)})

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 if it isn't there. All words take their steps together."""
        out = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else np.empty(0, np.int64)
        who = np.flatnonzero((sizes > 0) & (sizes <= _LONGEST))
        state, total, step = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), 0
        while len(who) and len(self.keys):
            key = state * 256 + data[starts[who] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            who, at = who[there], at[there]
            state, total, step = self.target[at].astype(np.int64), total[there] + self.number[at], step + 1
            ended = sizes[who] == step
            done = ended & (self.final[state] == 1)
            out[who[done]] = total[done]
            who, state, total = who[~ended], state[~ended], total[~ended]
        return out

    def of(self, place: int) -> np.ndarray:
        return self.ids[self.offset[place] : self.offset[place + 1]]


#: Letters, digits and white space of texts of Latin characters and common punctuation, which are composed already: cut by plain ranges.
_LETTERS, _DIGITS, _SPACES = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_BEYOND = re.compile("[^\u0000-\u012f\u0131-\u017f\u2010-\u2027]")


class WordBPE:
    """The vocabulary's own rules: how a text is cut into words, and how a word is merged."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        rules = json.loads(open(path, encoding="utf-8").read())
        self.normal, self.cutter = (t := Tokenizer.from_file(path)).normalizer, t.pre_tokenizer
        split = next(p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(split)
        latin = split.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _DIGITS).replace(r"\s", _SPACES)
        self.latin = re.compile(latin)
        self.vocabulary = rules["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spelled = {i: s for s, i in [*self.vocabulary.items(), *self.special.items()]}
        # ids of single bytes, inside a word and at its end; a pair of ids in one number -> its rank; rank -> id of the merged pair
        letters = byte_letters()
        self.bytes = {c: b for b, c in letters.items()}
        self.inner, self.last = ([self.vocabulary[letters[b] + end] for b in range(256)] for end in ("", _END))
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in rules["model"]["merges"]]
        self.rank = {self.vocabulary[x] << 32 | self.vocabulary[y]: k for k, (x, y) in enumerate(pairs)}
        self.merged = [self.vocabulary[x + y] for x, y in pairs]
        # letters and digits that this pattern engine knows and older character tables don't: texts with them are cut by the library
        every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
        self.new = frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")

    def words(self, text: str | None) -> list[str]:
        """The words of a text; special tokens' own spellings stay whole, as words of one id."""
        if not text:
            return []
        if "<|" not in text:
            return self._plain(text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out += [f"\0{part}"] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        # white space parts words in any form, so it needn't be made one blank
        if text.isascii() or not _BEYOND.search(text):
            return self.latin.findall(text.lower())
        text = self.normal.normalize_str(text)
        if self.new.isdisjoint(text):
            return self.word.findall(text)
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.cutter.pre_tokenize_str(text)]

    def merge(self, word: str) -> list[int]:
        """The ids of a word: of all neighbours that have a rank, the least merges first, the leftmost of equals."""
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        data = word.encode("utf-8", "replace")
        ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        return self._merge_few(ids) if len(ids) <= 64 else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        get, none = self.rank.get, len(self.merged)
        ranks = [get(x << 32 | y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k] = self.merged[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k) for k in range(n - 1) if (p := ids[k] << 32 | ids[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            least, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or rank.get(ids[k] << 32 | ids[j]) != least:
                continue  # one of them has merged since
            ids[k], ids[j], after[k] = self.merged[least], -1, after[j]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (found := rank.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (found, left))
        return [i for i in ids if i >= 0]

    def decoded(self, ids: np.ndarray) -> str:
        """The spellings of the ids with a blank between them, as the vocabulary without a decoder has it."""
        return " ".join(map(self.spelled.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def _rules(path: str) -> WordBPE:
    return WordBPE(path)


@functools.lru_cache(maxsize=2)
def _automaton(uri: str) -> Automaton:
    return Automaton.load(uri)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


class Encoder:
    """Ids of batches of texts: words through the automaton, unseen ones merged (a bounded number of them remembered)."""

    def __init__(self, automaton: Automaton, rules: WordBPE, room: int = 150_000):
        self.automaton, self.rules, self.room, self.unseen = automaton, rules, room, {}

    def _merged(self, word: str) -> np.ndarray:
        found = self.unseen.get(word)
        if found is None:
            found = np.array(self.rules.merge(word), np.int64)
            if len(word) <= _LONGEST:
                if len(self.unseen) >= self.room:
                    self.unseen.clear()
                self.unseen[word] = found
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        number = _Numbers()
        rows = [np.fromiter(map(number.__getitem__, words := self.rules.words(t)), np.int64, len(words)) for t in texts]
        words = list(number)
        place = self.automaton.places([w.encode("utf-8", "replace") for w in words])
        others = [self._merged(words[k]) for k in np.flatnonzero(place < 0).tolist()]
        # the ids of all distinct words one after the other, the automaton's first
        table = np.concatenate([self.automaton.ids, *others])
        ends = len(self.automaton.ids) + np.cumsum([0, *map(len, others)])
        start, end = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        seen = place >= 0
        start[seen], end[seen] = self.automaton.offset[place[seen]], self.automaton.offset[place[seen] + 1]
        start[~seen], end[~seen] = ends[:-1], ends[1:]
        out = []
        for row in rows:
            size = end[row] - start[row]
            first = np.cumsum(size) - size
            out.append(table[np.arange(size.sum()) + np.repeat(start[row] - first, size)])
        return out


def _cuts(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """Texts in lots of about ``chars`` characters; a longer text is a lot of its own."""
    lot, size = [], 0
    for t in texts:
        lot.append(t)
        size += len(t or "")
        if size >= chars:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _counted(path: str, room: int):
    """Partial counts (word, n) of the texts of a partition, let go whenever ``room`` distinct words have gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, counts = _rules(path), Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(rules.words(text.as_py()))
                if len(counts) >= room:
                    yield _table(counts)
                    counts.clear()
        yield _table(counts)

    def _table(counts: Counter) -> pa.RecordBatch:
        own = [(w, n) for w, n in counts.items() if len(w) <= _LONGEST and w[0] != "\0"]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

    return run


def frequent_words(texts: DataFrame, path: str, size: int, scratch: Scratch, room: int = 200_000) -> list[str]:
    """The most frequent words of all texts in the order of their bytes: as many classes of like counts, from the top, as hold at most ``size`` words."""
    counts = scratch.staged(texts.mapInArrow(_counted(path, room), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    level = F.floor(8 * F.log2("n")).cast("int")  # at most 512 classes
    classes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    fits = [k for (k, _), upto in zip(classes, np.cumsum([n for _, n in classes]).tolist(), strict=True) if upto <= size]
    words = [r["word"] for r in counts.where(level >= fits[-1]).select("word").toLocalIterator()] if fits else []
    return sorted((w for w in words if len(w.encode("utf-8", "replace")) <= _LONGEST), key=lambda w: w.encode("utf-8", "replace"))


def compile_lexicon(docs: DataFrame, uri: str, scratch: Scratch, *, text_col: str = "text", vocabulary: str | None = None, size: int = 1 << 17) -> Automaton:
    """Count the words of ``docs``, compile the most frequent ones and write the automaton to the file ``uri``."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    words = frequent_words(docs.select(F.col(text_col).cast("string").alias("text")), path, size, scratch)
    found = Automaton.compile([w.encode("utf-8", "replace") for w in words], [_rules(path).merge(w) for w in words])
    found.save(uri)
    return found


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = 1 << 17, lot_chars: int = 1 << 20) -> DataFrame:
    """doc_id, ids (array of int) and decoded of each row: see ``encode_batches``."""
    def rows(found):
        for i, ids, text in found:
            yield i, ids.tolist(), text

    return _mapped(docs, id_col, text_col, vocabulary, size, lot_chars, rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = 1 << 17, lot_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, from what ``encode`` returns.

    A null text counts as empty: no ids, an empty decoded text. Rows are encoded one by one: repeated rows and rows without an id
    have rows of their own. An empty table gives no rows; other columns are ignored. The automaton holds at most ``size`` words; what it holds
    changes only the time taken.
    """
    def rows(found):
        for i, ids, text in found:
            yield i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, id_col, text_col, vocabulary, size, lot_chars, rows, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, size: int, lot_chars: int, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    scratch = Scratch(docs.sparkSession, "lexicon")
    folder = fresh_dir(docs.sparkSession, "lexicon-file")
    uri = f"{folder}/words.automaton"
    compile_lexicon(docs, uri, scratch, text_col=text_col, vocabulary=path, size=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _rules(path)
        encoder = Encoder(_automaton(uri), rules)
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for lot in _cuts(batch.column(1).to_pylist(), lot_chars):
                found = [(next(ids), own, rules.decoded(own)) for own in encoder.encode(lot)]
                columns = list(zip(*rows(found), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out = scratch.last(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl))
    remove(docs.sparkSession, folder)
    return out
