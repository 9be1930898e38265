"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token sequences: its states are the tokens (what was read last), and an arc
from x to y, labelled y, says that y may follow x in a correct tokenization.  It starts with one
symbol per state and all arcs present.  Each merge (u, v), in rank order, applies one gadget:

* a new state uv gets the arcs that state v has at that time;
* the arc v leaves state u (u, v would have been merged);
* wherever an arc u leads, an arc uv leads as well.

``compile_arcs`` writes the result out as a table.  Labels are numbered so that a label is followed
by those that the third rule laid beside it, the latest first: what one merge takes from a state is
then one interval of labels, and a state lacks the union of its intervals.  States that lack the
same labels share a row of the table, and labels that the same states lack share a column, so that
49 thousand states and labels take 20 MB of bits.  The table is compiled once, on the driver, and
sent to the workers; it is bounded by the vocabulary.

Labels are spelled by one trie, which is the symbols' transition table: from a position the encoder
runs through it symbol by symbol, takes the longest label with an arc, and backs up over a state
that leads nowhere, which it never enters again.  Each word has exactly one accepted path.  Decoding
emits the labels of a path's arcs as the tokenizer file's decoder does.

Words are pre-split by the tokenizer file's own normaliser and pre-tokeniser; plain Latin chunks
take a shorter way with the same result.  White space separates chunks, so the chunks of a text
are encoded one by one, with caches bounded in bytes in each Python worker.  Strings of special
tokens inside a chunk give their own identifiers, as the library does by default.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Memo, append_columns, text_bytes

#: Keys of a trie node beside its symbols.
INNER, LAST = 0, 1
#: Bytes of one generation of the chunk cache and of the word cache of a Python worker.
CHUNK_BYTES = 64 << 20
WORD_BYTES = 24 << 20
#: Bytes of packed identifiers that are written out or decoded at once.
PACKED_BYTES = 1 << 20
#: Texts whose written and decoded forms are held at once.
ROWS_AT_ONCE = 256


def word_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [], 0x100
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


@dataclass(frozen=True)
class ArcTable:
    """The compiled arcs: a row of bits for the states that share it, a column for the labels that
    share it; a bit is 1 where the arc is absent.  ``row`` has the place of each state's row in
    ``absent``, ``column`` the column of each label.  ``idle`` has the tokens that no word gives, as
    their halves never met when their merge's turn came."""

    absent: bytes
    row: array
    column: array
    idle: frozenset[int]


def compile_arcs(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> ArcTable:
    """Applies the gadget of every merge in rank order and writes out the arcs."""
    size = max(vocabulary.values()) + 1
    gadgets, built = [], [0] * size
    beside: list[list[int]] = [[] for _ in range(size)]  # labels laid beside a label, by time
    for time, (u, v) in enumerate(merges, 1):
        i, j, k = vocabulary[u], vocabulary[v], vocabulary[u + v]
        if built[k]:
            raise ValueError(f"two merges make {u + v!r}; the automaton needs one")
        if max(built[i], built[j]) >= time:
            raise ValueError("a merge uses a token that is not built yet")
        built[k] = time
        gadgets.append((i, j, k))
        beside[i].append(k)
    place, stop = [0] * size, [0] * size
    at = 0
    todo = [(y, False) for y in range(size - 1, -1, -1) if not built[y]]
    while todo:
        y, done = todo.pop()
        if done:
            stop[y] = at
            continue
        place[y] = at
        at += 1
        todo.append((y, True))
        todo += [(k, False) for k in beside[y]]  # the latest comes off first

    # What each merge takes: label v and those laid beside it no earlier than the merge.
    none = np.zeros((0, 3), dtype=np.int32)
    own: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
    for time, (i, j, _) in enumerate(gadgets, 1):
        later = next((k for k in beside[j] if built[k] >= time), None)
        own[i].append((time, place[j], place[j] + 1 if later is None else stop[later]))
    taken = [np.array(o, dtype=np.int32) if o else none for o in own]
    idle = set()
    for time, (i, j, k) in enumerate(gadgets, 1):
        before = taken[i][: np.searchsorted(taken[i][:, 0], time)]
        if {i, j} & idle or ((before[:, 1] <= place[j]) & (place[j] < before[:, 2])).any():
            idle.add(k)
        inherited = taken[j][: np.searchsorted(taken[j][:, 0], time)]
        taken[k] = np.concatenate([inherited, taken[k]]) if len(taken[k]) else inherited

    rows: dict[bytes, int] = {}
    row, parts = array("i"), []
    for t in taken:
        order = np.argsort(t[:, 1], kind="stable")
        start, end = t[order, 1], np.maximum.accumulate(t[order, 2]) if len(t) else t[:, 2]
        new = np.ones(len(t), dtype=bool)
        new[1:] = start[1:] > end[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(t))[: len(first)] - 1
        union = np.stack([start[first], end[last]])
        found = rows.setdefault(union.tobytes(), len(rows))
        if found == len(parts):
            parts.append(union)
        row.append(found)

    # Labels that the same rows lack share a column: sums of random row numbers tell them apart.
    draws = np.random.default_rng(1).integers(0, 1 << 63, (2, len(parts)), dtype=np.uint64)
    step = np.zeros((2, size + 1), dtype=np.uint64)
    for k, union in enumerate(parts):
        step[:, union[0]] += draws[:, k, None]
        step[:, union[1]] -= draws[:, k, None]
    sums = np.cumsum(step, axis=1)[:, :size]
    _, shown, column = np.unique(sums, axis=1, return_index=True, return_inverse=True)
    lacks = []
    for union in parts:
        step = np.zeros(size + 1, dtype=np.int8)
        step[union[0]] += 1
        step[union[1]] -= 1
        lacks.append(np.packbits(np.cumsum(step, dtype=np.int8)[shown].view(bool), bitorder="little").tobytes())
    column = column.reshape(-1)[np.array(place)]
    return ArcTable(b"".join(lacks), array("i", np.array(row) * len(lacks[0])), array("i", column.tolist()), frozenset(idle))


class TokenizationAutomaton:
    """The automaton of a vocabulary and its ordered merges.

    ``vocabulary`` maps token strings to identifiers; ``end`` is the suffix that marks the last
    symbol of a word ("" for none); ``arcs`` is the compiled table, made here if not given.
    """

    def __init__(
        self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "", arcs: ArcTable | None = None
    ):
        self.end = end
        self.label = {i: t for t, i in vocabulary.items()}
        self.arcs = arcs or compile_arcs(vocabulary, merges)
        made = {u + v for u, v in merges}
        #: Labels of whole words, and the trie of all labels: INNER of a node has the (length, label,
        #: byte and bit of its column) of all labels on the way to it, longest first, LAST the label
        #: of a word's end there.
        self.whole: dict[str, int] = {}
        self.trie: dict = {}
        inner = {}
        self._byte = [c >> 3 for c in self.arcs.column]
        self._bit = [1 << (c & 7) for c in self.arcs.column]
        for token, i in vocabulary.items():
            last = bool(end) and token.endswith(end) and len(token) > len(end)
            body = token[: -len(end)] if last else token
            if i in self.arcs.idle or len(body) > 1 and token not in made:
                continue
            node = self.trie
            for symbol in body:
                node = node.setdefault(symbol, {})
            if last or not end:
                node[LAST] = self.whole[body] = i
            if not last:
                inner[body] = i
        todo = [(self.trie, "", ())]
        while todo:
            node, body, on_the_way = todo.pop()
            if body in inner:
                i = inner[body]
                on_the_way = ((len(body), i, self._byte[i], self._bit[i]), *on_the_way)
            todo += [(node[c], body + c, on_the_way) for c in node if c != LAST]
            node[INNER] = on_the_way
        self._row = self.arcs.row.tolist()
        self._longest = max(map(len, [*inner, *self.whole]), default=1)

    def arc(self, x: int, y: int) -> bool:
        """Whether y may follow x."""
        return not self.arcs.absent[self._row[x] + self._byte[y]] & self._bit[y]

    def encode(self, symbols: str) -> list[int]:
        """The one accepted path for a pre-split word, as identifiers."""
        whole = self.whole.get(symbols)
        if whole is not None:
            return [whole]
        if not symbols:
            return []
        absent, rows, longest, trie = self.arcs.absent, self._row, self._longest, self.trie
        n, at, state, path = len(symbols), 0, None, []
        passed: list[tuple] = []  # position, state and the labels not yet tried there
        dead: set[tuple[int, int]] = set()
        row = 0
        while True:
            # The symbols' transitions, as far as a label can be spelled.
            node = trie
            for symbol in symbols[at : at + longest]:
                after = node.get(symbol)
                if after is None:
                    break
                node = after
            else:
                last = node.get(LAST) if n - at <= longest else None
                if last is not None and (state is None or not absent[row + self._byte[last]] & self._bit[last]):
                    path.append(last)
                    return path
            labels = iter(node[INNER])
            while True:
                for length, label, byte, bit in labels:
                    if state is not None and absent[row + byte] & bit:
                        continue
                    stop = at + length
                    # Only a last label ends the word.
                    if stop == n or dead and (stop, label) in dead:
                        continue
                    break
                else:
                    if not passed:
                        raise ValueError(f"{symbols[:80]!r} has symbols outside the alphabet")
                    dead.add((at, state))
                    at, state, labels = passed.pop()
                    path.pop()
                    if state is not None:
                        row = rows[state]
                    continue
                break
            passed.append((at, state, labels))
            path.append(label)
            at, state = stop, label
            row = rows[label]


class PlainSplitter:
    """Pre-splits chunks of plain Latin letters, digits and marks without the library.

    Such chunks are in normal form and hold no white space, so lower case and the split pattern are
    all that the tokenizer file asks for; a file that asks for something else is not served.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: dict):
        asked = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        parts = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.serves = parts == ["NFC", "Replace", "Lowercase"] and json.dumps(self.PATTERN) in asked and "ByteLevel" in asked
        self.letters = byte_letters()
        self.plain = re.compile("[!-~¡-¬®-įı-ɏ]+")
        self.split = regex.compile(self.PATTERN)
        self.split_ascii = re.compile(self.PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))

    def words(self, text: str) -> list[str] | None:
        """Words in byte letters, or None for what is not plain."""
        if not (self.serves and self.plain.fullmatch(text)):
            return None
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        letters = self.letters
        return [
            w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in self.split.findall(text.lower())
        ]


class WordCodec:
    """Encodes and decodes whole texts as the tokenizer file at ``path`` asks."""

    def __init__(self, path: str, cache_bytes: int = CHUNK_BYTES, arcs: ArcTable | None = None):
        from tokenizers import Tokenizer

        vocabulary, merges, spec = model_parts(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        end = spec["model"].get("end_of_word_suffix") or ""
        self.automaton = TokenizationAutomaton(vocabulary, merges, end, arcs)
        if spec["decoder"] is not None or spec["model"]["unk_token"] is not None:
            raise ValueError("only files without decoder and unknown token are supported")
        self.label = {**self.automaton.label, **{i: t for t, i in self.special.items()}}
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.plain = PlainSplitter(spec)
        self.word = Memo(self._word, min(cache_bytes, WORD_BYTES), len)
        self.chunk = Memo(self._chunk, cache_bytes, len)
        ids = range(max(self.label, default=-1) + 1)
        #: What each identifier is written as, and the label that it gives.
        self.written = pa.array([b"%d" % i for i in ids])
        self.labels = pa.array([self.label[i].encode() if i in self.label else None for i in ids], pa.binary())
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def words(self, text: str) -> list[str]:
        """Pre-split words of a stretch without special tokens, in byte letters."""
        words = self.plain.words(text)
        if words is None:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return words

    def _word(self, word: str) -> bytes:
        """Packed identifiers of a pre-split word."""
        return array("i", self.automaton.encode(word)).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        """The same for a chunk between white space."""
        if chunk.isalpha() and self.plain.serves:  # Latin letters without marks are one word
            return self.word[chunk.lower().decode()]
        text = chunk.decode()
        if "<|" not in text:
            return b"".join(map(self.word.__getitem__, self.words(text)))
        found = []
        for stretch in self.cut.split(text):
            if stretch in self.special:
                found.append(array("i", [self.special[stretch]]).tobytes())
            elif stretch:
                found += map(self.word.__getitem__, self.words(stretch))
        return b"".join(found)

    def decode(self, ids) -> str:
        """The labels of the path, joined as the library joins tokens where no decoder is set."""
        return " ".join(map(self.label.__getitem__, ids))

    def pack(self, text: bytes) -> bytes:
        """Packed identifiers of a whole UTF-8 text."""
        return b"".join(map(self.chunk.__getitem__, text.split()))

    def encode_text(self, text: bytes) -> tuple[bytes, bytes]:
        """Decimal identifiers and packed identifiers of a whole UTF-8 text."""
        packed = self.pack(text)
        return joined(self.written, [packed])[0], packed

    def decode_packed(self, packed: bytes) -> bytes:
        """The decoded text of packed identifiers, in UTF-8."""
        return joined(self.labels, [packed])[0]


def joined(names: pa.BinaryArray, packed: list[bytes]) -> list[bytes]:
    """For each text's packed identifiers their ``names``, joined by spaces; PACKED_BYTES at a time."""
    found: list[bytes] = []
    group, size = [], 0

    def of_group(parts: list[bytes]) -> list[bytes]:
        ends = np.cumsum([0, *[len(p) // 4 for p in parts]])
        ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(ids)), b" ").to_pylist()

    for flat in packed:
        if size + len(flat) > PACKED_BYTES:
            found += of_group(group)
            group, size = [], 0
        if len(flat) > PACKED_BYTES:
            parts = range(0, len(flat), PACKED_BYTES)
            found.append(b" ".join([of_group([flat[a : a + PACKED_BYTES]])[0] for a in parts]))
        else:
            group.append(flat)
            size += len(flat)
    return found + of_group(group)


def model_parts(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict]:
    """Vocabulary, ordered merges and the whole specification of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, spec


@lru_cache(maxsize=2)
def arc_table(path: str) -> ArcTable:
    """The compiled table of the tokenizer file, worked out once in the driver."""
    return compile_arcs(*model_parts(path)[:2])


#: The codecs of this Python worker, with their caches.
_CODECS: dict[str, WordCodec] = {}


def codec(path: str, arcs: ArcTable | None = None) -> WordCodec:
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = WordCodec(path, arcs=arcs)
        # The tables stay for good and hold no cycles; the collector need not walk them.
        gc.collect()
        gc.freeze()
    return _CODECS[path]


def _codec_starter(df: DataFrame, model_path: str | None) -> Callable[[], WordCodec]:
    """Gives the codec in a worker; the compiled table travels there once, as a broadcast."""
    path = model_path or word_model_path()
    shared = df.sparkSession.sparkContext.broadcast(arc_table(path))
    return lambda: codec(path, shared.value)


def encode(
    df: DataFrame, text: str = "text", model_path: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with token_ids (array of int), n_tokens, and the SHA-256 of the decimal identifiers
    and of the decoded text (ids_sha256, decoded_sha256), in one pass.

    A null or empty text has no identifiers; texts are taken whole; repeated rows are encoded
    each; an empty table gives an empty table; input columns named like the results are replaced.
    """
    shared_codec = _codec_starter(df, model_path)

    def start():
        of = shared_codec()

        def work(texts: list[bytes]):
            found, flat = _digests(of, texts, True)
            ends = np.cumsum([0, *found[0]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "<i4")))
            return lists, *found

        return work

    fields = [("token_ids", T.ArrayType(T.IntegerType())), *DIGEST]
    return append_columns(df, [text_bytes(text)], fields, start, keep)


DIGEST = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _digests(of: WordCodec, texts: list[bytes], packed: bool = False):
    """n_tokens and the two hashes of every text, and all packed identifiers if asked for.

    Each text is encoded, and its identifiers are decoded.
    """
    counts, ids_sha, text_sha, kept = [], [], [], []
    for a in range(0, len(texts), ROWS_AT_ONCE):
        flat = [of.pack(text) for text in texts[a : a + ROWS_AT_ONCE]]
        counts += [len(f) // 4 for f in flat]
        for out, names in ((ids_sha, of.written), (text_sha, of.labels)):
            out += [hashlib.sha256(t).hexdigest() for t in joined(names, flat)]
        if packed:
            kept += flat
    return (counts, ids_sha, text_sha), b"".join(kept)


def decode(df: DataFrame, ids: str = "token_ids", model_path: str | None = None) -> DataFrame:
    """``df`` with decoded_text for every row; a null list gives null, an empty one ""."""
    shared_codec = _codec_starter(df, model_path)

    def start():
        emit = shared_codec().decode
        return lambda rows: ([None if r is None else emit(r) for r in rows],)

    return append_columns(df, [F.col(ids)], [("decoded_text", T.StringType())], start)


def digest(
    df: DataFrame, text: str = "text", model_path: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with n_tokens and the SHA-256 of identifiers and of the decoded text of each row.

    Encodes and decodes in one pass; a null text counts as empty (0 tokens, hashes of "").
    """
    shared_codec = _codec_starter(df, model_path)

    def start():
        of = shared_codec()
        return lambda texts: _digests(of, texts)[0]

    return append_columns(df, [text_bytes(text)], DIGEST, start, keep)


def query(documents: DataFrame) -> DataFrame:
    return digest(documents, keep=["doc_id"])


