"""Byte-level BPE encoding and decoding with a transducer lexicon.

Frequent words are compiled into a minimal acyclic transducer: an automaton
that shares prefixes and suffixes and whose arc outputs add up to a word's
number, with which its token ids are found.  Its arrays go to every executor as
one file, which the workers memory-map (one copy in the page cache of a
machine).  Words that it does not accept are merged exactly by the tokenizer's
own rules.  A worker numbers the words it meets, so it asks the automaton (or
merges) once a word while its bounded table holds the word.  The words that
are compiled are the ``LEXICON_WORDS`` most frequent ones (of at most 64
characters) by exact counts over all texts; they steer the speed, never the
ids.

A text is cut at special strings first (each is its own id, as the tokenizer
does by default), then into words by the byte-level pattern.  Encoding gives
the same ids as the library for the whole text, decoding the same text,
special tokens kept.

A null text counts as empty: no ids, and decoded as the empty text; null ids
decode to the empty text.  Repeated rows and other columns change nothing.
Texts of any length are taken whole; a worker's memory follows a piece of
texts (about ``ENCODE_BYTES``, handed on before the next is begun) or the
longest one.  ``round_trip`` adds one column, under a name that is free.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.shared import flat_index, local_file, send_file, ship, top_words

MODEL = "byte_bpe_50k.json"
LEXICON_WORDS = 32_768
HELD_WORDS = 400_000   # a worker forgets its words past so many, or past
HELD_CHARS = 8_000_000  # so many characters of them
ENCODE_BYTES = 1_000_000  # of texts encoded and handed on together

# Fixed value: the public byte-level pattern (no added space before the text).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for texts of plain Latin letters, where the built-in classes agree
# with the Unicode ones; it is the faster one.
LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNLIKE = bytes([*range(9), *range(14, 32), *range(127, 160), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
# Letters of these scripts may be classed differently by the tokenizer's
# (older) Unicode tables; texts that have them are cut by the tokenizer itself.
_OTHER = re.compile("[\u0530-\u1fff\u2070-\u209f\u2c00-\u2dff\u3040-\U0010ffff]")


def _is_latin(text: str) -> bool:
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(data.translate(None, _UNLIKE)) == len(data)


def split(text: str) -> list[str]:
    """Words of a text by the public pattern."""
    return (LATIN if _is_latin(text) else PATTERN).findall(text)


class _Numbered(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes as themselves, the others from 256 on."""
    keep = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


_CHARS = _alphabet()


# ---- the minimal acyclic transducer --------------------------------------


class Transducer:
    """Word to number, over bytes.

    ``base`` holds a displacement per state; the arc of byte ``c`` from state
    ``s`` is slot ``base[s] + c`` when ``owner`` of the slot is ``s``: ``to``
    is the next state, ``out`` the output.  ``final`` marks accepting states.
    """

    def __init__(self, base, owner, to, out, final):
        self.base, self.owner, self.to, self.out, self.final = base, owner, to, out, final

    @classmethod
    def compile(cls, words: list[bytes]) -> Transducer:
        """Minimal automaton of sorted, distinct words, built one word at a time."""
        known: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = []       # of frozen states
        final: list[bool] = []
        path: list[tuple[dict[int, int], bool]] = [({}, False)]

        def freeze(state: dict[int, int], accepts: bool) -> int:
            sig = (accepts, tuple(state.items()))
            if sig not in known:
                known[sig] = len(arcs)
                arcs.append(state)
                final.append(accepts)
            return known[sig]

        def shorten(to: int, word: bytes) -> None:
            while len(path) > to + 1:
                state, accepts = path.pop()
                path[-1][0][word[len(path) - 1]] = freeze(state, accepts)

        last = b""
        for w in words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            shorten(same, last)
            for _ in w[same:]:
                path.append(({}, False))
            path[-1] = (path[-1][0], True)
            last = w
        shorten(0, last)
        root = freeze(*path[0])
        # words below each state: children are frozen before their parents
        below = np.zeros(len(arcs), dtype=np.int64)
        for s, state in enumerate(arcs):
            below[s] = int(final[s]) + sum(int(below[t]) for t in state.values())
        # an arc puts out the number of words that come before those behind it
        size = 256 + sum(len(a) for a in arcs) + 512
        free = np.ones(size, dtype=bool)
        base, placed = np.zeros(len(arcs), dtype=np.int32), []
        first = 0
        for s in sorted(range(len(arcs)), key=lambda s: -len(arcs[s])):
            state = arcs[s]
            if not state:
                continue
            labels = np.fromiter(state, dtype=np.int64)
            while first < size and not free[first]:
                first += 1
            at = first
            while True:
                if at + 512 > size:
                    free = np.r_[free, np.ones(size, dtype=bool)]
                    size = len(free)
                cand = np.flatnonzero(free[at:at + 4096]) + at - labels[0]
                cand = cand[(cand >= 0) & (cand + labels[-1] < size)]
                ok = free[cand[:, None] + labels].all(axis=1) if len(cand) else np.empty(0, bool)
                if ok.any():
                    base[s] = cand[ok][0]
                    break
                at += 4096
            free[base[s] + labels] = False
            placed.append(s)
        slots = int(max((int(base[s]) for s in placed), default=0)) + 257
        owner = np.full(slots, -1, dtype=np.int32)
        to, out = np.zeros(slots, dtype=np.int32), np.zeros(slots, dtype=np.int32)
        for s in placed:
            before = int(final[s])
            for c, t in arcs[s].items():
                k = base[s] + c
                owner[k], to[k], out[k] = s, t, before
                before += int(below[t])
        flags = np.array(final, dtype=bool)
        # the root becomes state 0
        return cls(base, owner, to, out, flags)._rooted(root)

    def _rooted(self, root: int) -> Transducer:
        def swap(x):
            return np.where(x == root, 0, np.where(x == 0, root, x)).astype(np.int32)

        self.base[[0, root]] = self.base[[root, 0]]
        self.final[[0, root]] = self.final[[root, 0]]
        live = self.owner >= 0
        self.owner = np.where(live, swap(self.owner), -1).astype(np.int32)
        self.to = np.where(live, swap(self.to), 0).astype(np.int32)
        return self

    def numbers(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Number of each word ``data[start:start+len]``, -1 when not accepted.

        All words step together, the k-th step reads each one's k-th byte.
        """
        n = len(lens)
        state, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        found = np.full(n, -1, dtype=np.int64)
        live = np.arange(n)
        for k in range(int(lens.max(initial=0)) + 1):
            ended = lens[live] == k
            if ended.any():
                e = live[ended]
                good = self.final[state[e]]
                found[e[good]] = total[e[good]]
                live = live[~ended]
            if not len(live):
                break
            slot = self.base[state[live]].astype(np.int64) + data[starts[live] + k]
            good = self.owner[slot] == state[live]
            live, slot = live[good], slot[good]
            total[live] += self.out[slot]
            state[live] = self.to[slot]
        return found


# ---- encoding --------------------------------------------------------------


class Encoder:
    """The library's ids for whole texts, by the lexicon and exact merges."""

    def __init__(self, model: str, lexicon: dict[str, np.ndarray] | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.lexicon = lexicon
        if lexicon is not None:
            self.auto = Transducer(*(lexicon[k] for k in ("base", "owner", "to", "out", "final")))
        self.merges = self._merger(model)
        self._forget()

    def _forget(self) -> None:
        self.code, self.chars = _Numbered(), 0
        ids = self.lexicon["ids"] if self.lexicon is not None else np.empty(0, np.int32)
        self.pool = np.asarray(ids, dtype=np.int32)  # ids of the lexicon, then of merged words
        self.starts, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)  # of each numbered word's ids
        self.accepted = np.empty(0, bool)

    @property
    def cache(self) -> set[str]:
        """Words held that the lexicon lacks."""
        return {w for w, ok in zip(self.code, self.accepted) if not ok}

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        if _is_latin(text):
            return LATIN.findall(text)
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return PATTERN.findall(text)

    def _merger(self, model: str) -> tiktoken.Encoding | None:
        """Byte-pair merging by rank, where the vocabulary's ids are its merge order."""
        m = json.loads(model)["model"]
        vocab, ranks = m["vocab"], {bytes(_CHARS[c] for c in s): i for s, i in m["vocab"].items()}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        if len(ranks) != 256 + len(pairs) or any(vocab["".join(x)] != 256 + k for k, x in enumerate(pairs)):
            return None
        return tiktoken.Encoding("merges", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})

    def merged(self, words: list[str]) -> list[list[int]]:
        """Exact ids of single words by the tokenizer's merges."""
        if self.merges is not None:
            merge = self.merges._core_bpe.encode_single_piece
            return [merge(w.encode("utf-8")) for w in words]
        return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Places of the ids of words numbered since the last call."""
        n = len(words)
        starts, lens, hit = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        if self.lexicon is not None:
            data = [w.encode("utf-8") for w in words]
            wl = np.fromiter(map(len, data), dtype=np.int64, count=n)
            num = self.auto.numbers(np.frombuffer(b"".join(data) + b"\0", dtype=np.uint8), np.cumsum(wl) - wl, wl)
            hit = num >= 0
            at = self.lexicon["offsets"]
            starts[hit], lens[hit] = at[num[hit]], at[num[hit] + 1] - at[num[hit]]
        rest = np.flatnonzero(~hit)
        ids = self.merged([words[i] for i in rest.tolist()])
        k = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        starts[rest], lens[rest] = len(self.pool) + np.cumsum(k) - k, k
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(k.sum()))])
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        self.accepted = np.concatenate([self.accepted, hit])
        self.chars += sum(map(len, words))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        if len(self.code) > HELD_WORDS or self.chars > HELD_CHARS:
            self._forget()
        code, known = self.code, len(self.code)
        seq: list[int] = []
        per: list[int] = []
        for t in texts:
            before = len(seq)
            for k, part in enumerate(self.cut.split(t) if self.cut else [t]) if t else ():
                if k % 2:
                    seq.append(-1 - self.special[part])
                elif part:
                    seq.extend(map(code.__getitem__, self.words(part)))
            per.append(len(seq) - before)
        if len(code) > known:
            self.learn(list(islice(code, known, None)))
        s = np.fromiter(seq, dtype=np.int64, count=len(seq))
        marks = np.flatnonzero(s < 0)
        word = s >= 0
        w_start, w_len = np.zeros(len(s), dtype=np.int64), np.ones(len(s), dtype=np.int64)
        w_start[word], w_len[word] = self.starts[s[word]], self.lens[s[word]]
        ids = self.pool[flat_index(w_start, w_len)] if len(self.pool) else np.zeros(len(s), np.int32)
        ends = np.r_[0, np.cumsum(w_len)]
        ids[ends[marks]] = -1 - s[marks]
        return ids, np.diff(np.r_[0, ends[np.cumsum(per, dtype=np.int64)]]) if per else np.empty(0, np.int64)


def build_lexicon(words: list[str], encoder: Encoder) -> bytes:
    """File of the transducer over ``words`` and of the ids behind its numbers."""
    pairs = sorted((w.encode("utf-8"), w) for w in set(words))
    ids = [x for lo in range(0, len(pairs), 10_000)
           for x in map(np.array, encoder.merged([w for _, w in pairs[lo:lo + 10_000]]))]
    auto = Transducer.compile([b for b, _ in pairs])
    arrays = {"base": auto.base, "owner": auto.owner, "to": auto.to, "out": auto.out, "final": auto.final,
              "offsets": np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64),
              "ids": np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)}
    head, body = {}, io.BytesIO()
    for name, x in arrays.items():
        body.write(b"\0" * (-body.tell() % 64))
        head[name] = [body.tell(), str(x.dtype), len(x)]
        body.write(np.ascontiguousarray(x).tobytes())
    h = json.dumps(head).encode().ljust(1024)
    return h + body.getvalue()


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    """Memory-map the arrays of a lexicon file."""
    with open(path, "rb") as f:
        head = json.loads(f.read(1024))
    return {name: np.memmap(path, dtype=kind, mode="r", offset=1024 + at, shape=(n,)) if n
            else np.empty(0, dtype=kind) for name, (at, kind, n) in head.items()}


_WORKER: dict = {}


def _worker_encoder(name: str, model) -> Encoder:
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Encoder(model.value, map_lexicon(local_file(name)))
    return _WORKER[name]


def _model(model_path: str | None) -> str:
    with open(model_path or public_tokenizers.path(MODEL), encoding="utf-8") as f:
        return f.read()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``ENCODE_BYTES`` each (one at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENCODE_BYTES, "right")))
        yield lo, hi
        lo = hi


def _lists(ids: np.ndarray, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(ids, pa.int32()))


def _prepared(df: DataFrame, text_col: str, model_path: str | None, lexicon_words: int):
    """(the model, broadcast; name of the lexicon file sent to the executors)."""
    spark = df.sparkSession
    ship(spark)
    model = _model(model_path)
    words = top_words(df, text_col, split, lexicon_words)
    encoder = Encoder(model)
    name = send_file(spark, build_lexicon([w for w in words if w not in encoder.special], encoder), ".lexicon")
    return spark.sparkContext.broadcast(model), name


def ids_column(df: DataFrame, text_col: str, model_path: str | None = None,
               lexicon_words: int = LEXICON_WORDS) -> F.Column:
    """Column: token ids (array of int) of each whole text."""
    sent, name = _prepared(df, text_col, model_path, lexicon_words)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = _worker_encoder(name, sent)
        parts = [_lists(*enc.encode(texts.slice(lo, hi - lo).to_pylist())) for lo, hi in _slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(F.col(f"`{text_col}`"))


def round_trip(df: DataFrame, text_col: str, keep: list[str], out: str = "bpe", with_text: bool = True,
               model_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """The columns ``keep`` and a struct ``out`` of each text: ids, decoded text, whether it is the text again.

    Encoding and decoding are one pass over slices of about ``ENCODE_BYTES``,
    each handed on and freed before the next.  Without ``with_text`` the decoded
    text is null.  If ``keep`` has a column ``out``, underscores are added.
    """
    sent, name = _prepared(df, text_col, model_path, lexicon_words)
    tag = hash(sent.value)
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        enc, dec = _worker_encoder(name, sent), _worker_decoder(tag, sent)
        for b in batches:
            column = b.column("t")
            for lo, hi in _slices(column):
                texts = column.slice(lo, hi - lo).to_pylist()
                ids, lens = enc.encode(texts)
                ends = np.cumsum(lens)
                back = [dec.decode(ids[a:z]) for a, z in zip(ends - lens, ends)]
                same = [x == (t or "") for x, t in zip(back, texts)]
                got = pa.StructArray.from_arrays(
                    [_lists(ids, lens), pa.array(back if with_text else [None] * len(back), pa.string()),
                     pa.array(same, pa.bool_())], ["ids", "decoded", "same"])
                kept = [b.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, got], [*(f"k{i}" for i in range(len(keep))), "bpe"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("bpe", T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
        T.StructField("same", T.BooleanType())]))])
    have = {c.lower() for c in keep}
    while out.lower() in have:
        out += "_"
    return rows.mapInArrow(run, schema).toDF(*keep, out)


# ---- decoding --------------------------------------------------------------


class Decoder:
    """Ids to text by a table of each token's bytes, special tokens kept."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model)
        self.n = tok.get_vocab_size(with_added_tokens=True)
        table = []
        for i in range(self.n):
            s = tok.id_to_token(i) or ""
            table.append(bytes(_CHARS[c] for c in s) if all(c in _CHARS for c in s) else s.encode("utf-8"))
        self.lens = np.array([len(b) for b in table], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < self.n)]  # unknown ids have no text, as in the library
        return self.blob[flat_index(self.starts[ids], self.lens[ids])].tobytes().decode("utf-8", "replace")


_DECODER: dict = {}


def _worker_decoder(tag: int, model) -> Decoder:
    if tag not in _DECODER:
        _DECODER.clear()
        _DECODER[tag] = Decoder(model.value)
    return _DECODER[tag]


def text_column(df: DataFrame, ids_col: str, model_path: str | None = None) -> F.Column:
    """Column: the text that a column of token ids stands for."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(_model(model_path))
    tag = hash(sent.value)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        dec = _worker_decoder(tag, sent)
        flat = ids.values.to_numpy(zero_copy_only=False) if ids.values.null_count == 0 else \
            ids.values.fill_null(-1).to_numpy()
        at = ids.offsets.to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return pa.array(["" if null[i] else dec.decode(flat[at[i]:at[i + 1]]) for i in range(len(ids))], pa.string())

    return text(F.col(f"`{ids_col}`"))
