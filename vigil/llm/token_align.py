"""Cross-tokenizer alignment by merge-path partitioning.

A text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte
fallback); both cover the bytes of a blank and the text.  Their token ends are
two sorted lists, and one merge of them gives everything: a step that takes the
end of a token meets the token of the other side that is open there, which is a
link, and an end that both sides share closes a group.

1. The merge is cut at equal steps: a binary search along each diagonal of the
   merge grid tells how many ends of A and of B lie before it (``merge_path``).
   Each piece is merged for itself (``merge_piece``) and has the same work
   whatever the lengths of the texts.
2. A text of at most ``deal`` steps is merged where it was encoded, together
   with its neighbours.  The pieces of longer ones are rows that Spark deals
   out over all tasks; each emits its links, the groups that it holds whole, and
   the open ends before its first and after its last shared end.
3. The pieces of a text, sorted by number, are read as a stream that stitches
   open ends into groups, hashes the groups and merges the links' id pairs.
4. How many texts hold an id pair linked is summed from one partial count a
   task.  The most frequent pairs, at most ``frequent``, are broadcast; the rest
   meet their counts by a join that has no frequent key.

Words are encoded once per task and kept: what stands between two single blanks
that stand between non-blanks is encoded alike wherever it stands.  A's pattern
starts a new token there, and no piece of B has a blank behind another character
(checked when the model is opened; otherwise whole texts are encoded).

Columns other than doc_id and text are not read; repeated and null ids are rows
like others.  A text that is null, empty or not covered by both tokenizers has no
tokens: zeros, and '' for its groups.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigil.llm.common import materialize

STEPS = 1 << 15  # merge steps of one piece
DEAL = 1 << 16  # a text of more steps is dealt out in pieces
FREQUENT = 1 << 18  # most id pairs that are broadcast, 16 bytes each
CACHE = 300_000  # words kept by each Python worker
SLICE = 2 << 20  # characters that are encoded and merged together
HELD = 1 << 21  # pairs that a task counts before it passes them on
_LATIN = "ɏ"  # beyond, the tokenizer itself is asked instead of its twin by ranks
_blanks = re.compile(r"\s\s|^\s|\s$")
_single = re.compile(r"(?<=\S) (?=\S)")
_byte_piece = re.compile(r"<0x([0-9A-F]{2})>")

DIGEST = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokenizer_paths() -> tuple[str, str, str]:
    """A's file, its vocabulary as ranks, and B's model."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model")


# --- the merge -------------------------------------------------------------------------------------------------------

def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted ends ``a`` and ``b`` the first d steps of their merge take, for each d of ``diagonals``.

    At equal ends A's is taken first.  All diagonals are searched at once."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while np.any(open_ := low < high):
        mid = (low + high) // 2
        j = diagonals - mid - 1
        more = np.zeros(len(mid), bool)
        more[open_] = a[mid[open_]] <= b[j[open_]]  # a[mid] comes before b[j], so more of a lies before the diagonal
        low, high = np.where(open_ & more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, diagonals - low


def merge_piece(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the ends of one piece; ``before`` is A's last end before it.

    Returns, for each end of ``a``, the index of B's open token; for each end of
    ``b``, the index of A's open token; and whether that end of ``b`` closes a
    group, when it has no link of its own.  An index may be one past the piece."""
    to_b = np.searchsorted(b, a, "left")
    to_a = np.searchsorted(a, b, "right")
    last = np.where(to_a > 0, a[np.maximum(to_a - 1, 0)] if len(a) else 0, before)
    return to_b, to_a, last == b


def merge(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merge_piece`` over whole lists, in pieces of ``steps``."""
    cuts = np.arange(0, len(a) + len(b) + steps, steps)
    i, j = merge_path(a, b, np.minimum(cuts, len(a) + len(b)))
    got = [[], [], []]
    for k in range(len(cuts) - 1):
        to_b, to_a, shared = merge_piece(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]], int(a[i[k] - 1]) if i[k] else -1)
        for out, x in zip(got, (to_b + j[k], to_a + i[k], shared)):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)


# --- the tokenizers --------------------------------------------------------------------------------------------------

def _grown(old: np.ndarray, n: int) -> np.ndarray:
    new = np.zeros(max(2 * len(old), n), old.dtype)
    new[:len(old)] = old
    return new


class _Side:
    """Ids and byte lengths of words' tokens, one after the other."""

    def __init__(self):
        self.ids, self.lens = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.starts, self.used = [0], 0

    def add(self, ids: list[int], lens: list[int]) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids, self.lens = _grown(self.ids, self.used + len(ids)), _grown(self.lens, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.lens[self.used:self.used + len(ids)] = lens
        self.used += len(ids)
        self.starts.append(self.used)

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of a sequence of words, and how many tokens each word has."""
        starts = np.array(self.starts)
        n = starts[words + 1] - starts[words]
        at = np.arange(int(n.sum())) + np.repeat(starts[words] - np.cumsum(n) + n, n)
        return self.ids[at], self.lens[at], n


class Encoders:
    """Both tokenizers, with the words that they met."""

    _made: dict[tuple, Encoders] = {}

    @classmethod
    def of(cls, paths: tuple[str, str, str]) -> Encoders:
        """One per Python worker."""
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def __init__(self, file: str, ranks: str, model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_file(file)
        self.whole.encode_special_tokens = True  # their strings in a text are plain text
        with open(file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        chars = {c: bytes([x]) for x, c in _byte_chars().items()}
        self.a_bytes = {i: b"".join(chars.get(c, c.encode()) for c in t) for t, i in vocabulary.items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.pieces.is_byte(i) and (m := _byte_piece.fullmatch(t)) else t.replace("▁", " ").encode()
                        for i, t in enumerate(names)]
        self.by_word = not any("▁" in t.lstrip("▁") for t in names)
        self.ids_a, self.ids_b = max(self.a_bytes) + 1, len(names)
        self.clear()

    def clear(self) -> None:
        self.a, self.b, self.covered, self.seen = _Side(), _Side(), [], {}

    def word(self, word: str) -> int:
        """Encode a blank and ``word``; its number from now on."""
        text = " " + word
        if not text.isascii() and max(text) > _LATIN:
            a = self.whole.encode(text, add_special_tokens=False).ids
        else:
            a = self.fast.encode_ordinary(text)
        b = self.pieces.encode(word)
        raw, a_raw, b_raw = text.encode(), [self.a_bytes.get(i, b"") for i in a], [self.b_bytes[i] for i in b]
        self.a.add(a, [len(x) for x in a_raw])
        self.b.add(b, [len(x) for x in b_raw])
        self.covered.append(b"".join(a_raw) == raw and b"".join(b_raw) == raw)
        self.seen[word] = n = len(self.covered) - 1
        return n

    def encode(self, texts: list[str | None]):
        """Ids and lengths of A and B, one text after the other, and each text's number of tokens."""
        if len(self.seen) > CACHE or self.a.used > 16 * CACHE:
            self.clear()
        get, word = self.seen.get, self.word
        words, owner = [], []
        for t in texts:
            if not t:
                owner.append(0)
                continue
            if not self.by_word:
                parts = [t]
            elif _blanks.search(t):
                parts = _single.split(t)
            else:
                parts = t.split(" ")
            found = [get(p) for p in parts]
            if None in found:
                found = [word(p) if (n := get(p)) is None else n for p in parts]
            words += found
            owner.append(len(found))
        words = np.array(words, np.int64)
        owner = np.repeat(np.arange(len(texts)), owner)
        lost = np.bincount(owner, ~np.array(self.covered, bool)[words] if len(words) else None, len(texts)) > 0
        keep = ~lost[owner]
        words, owner = words[keep], owner[keep]
        out = []
        for side in (self.a, self.b):
            ids, lens, n = side.take(words)
            out += [ids, lens, np.bincount(owner, n, len(texts)).astype(np.int64)]
        return out


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones stand
    for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(own)]
    return {x: chr(x) for x in own} | {x: chr(256 + i) for i, x in enumerate(rest)}


# --- results of a piece ----------------------------------------------------------------------------------------------

_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n-1, right-aligned, a place for what follows, and which bytes are used."""
    if n not in _DIGITS:
        width = len(str(max(1, n - 1)))
        v = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)[None, :]
        used = v > 0
        used[:, -1] = True
        _DIGITS[n] = (np.concatenate([(v % 10 + 48).astype(np.uint8), np.zeros((n, 1), np.uint8)], 1),
                      np.concatenate([used, np.ones((n, 1), bool)], 1))
    return _DIGITS[n]


def written(a_ids, a_group, b_ids, b_group, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` for each group, as bytes, and where the tokens of each group begin in them."""
    ids, group = np.concatenate([a_ids, b_ids]), np.concatenate([a_group, b_group])
    side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    digits, used = _decimals(n_ids)
    text, used = digits[ids], used[ids]
    last = np.ones(len(ids), bool)
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    text[:, -1] = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
    sizes = np.cumsum(used.sum(1))
    starts = np.searchsorted(group, np.arange(int(group[-1]) + 2 if len(group) else 1))
    return text[used], np.concatenate([[0], sizes])[starts]


def pack_pairs(pairs: np.ndarray, links: np.ndarray) -> bytes:
    """Sorted pairs and their numbers of links; differences, compressed."""
    wide = np.diff(pairs, prepend=0)
    n = np.int64(len(pairs))
    small = len(pairs) == 0 or (wide.max() < 1 << 32 and links.max() < 1 << 16)
    raw = n.tobytes() + (b"\0" + wide.astype("<u4").tobytes() + links.astype("<u2").tobytes() if small
                         else b"\1" + wide.astype("<u8").tobytes() + links.astype("<u8").tobytes())
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_pairs(made: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(made[8:], int.from_bytes(made[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    wide, counted = (("<u4", "<u2"), ("<u8", "<u8"))[raw[8]]
    first = np.frombuffer(raw, wide, n, 9)
    return np.cumsum(first.astype(np.int64)), np.frombuffer(raw, counted, n, 9 + first.nbytes).astype(np.int64)


def _counted(pairs: np.ndarray, links: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if links is None:
        return np.unique(pairs, return_counts=True)
    kinds, at = np.unique(pairs, return_inverse=True)
    return kinds, np.bincount(at, links, len(kinds)).astype(np.int64)


_TOTALS = ("n_a", "n_b", "n_groups", "n_links")
_WHOLE = {**dict.fromkeys(_TOTALS, "long"), "groups_sha256": "string", "pairs": "binary"}
_PIECE = {"piece": "int", "before": "long", **dict.fromkeys(("a_ids", "a_ends", "b_ids", "b_ends"), "binary")}
_MERGED = {"piece": "int", **dict.fromkeys(_TOTALS, "long"), **dict.fromkeys(("pairs", "open_a", "open_b", "body", "rest_a", "rest_b"), "binary")}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _ddl(doc_id: str, fields: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in {"rid": "long", "doc_id": doc_id, **fields}.items())


def _batch(doc_id: pa.DataType, fields: dict[str, str], rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("rid", pa.int64()), ("doc_id", doc_id), *((c, _ARROW[t]) for c, t in fields.items())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _align(enc: Encoders, texts: list[str | None], steps: int, deal: int) -> Iterator[tuple[int, dict]]:
    """Rows of texts, with the text's number: whole ones (no piece), or the pieces of long ones."""
    a_ids, a_lens, n_a, b_ids, b_lens, n_b = enc.encode(texts)
    a_end, b_end = np.cumsum(a_lens, dtype=np.int64), np.cumsum(b_lens, dtype=np.int64)
    a_at, b_at = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    for d in np.flatnonzero(n_a + n_b > deal):
        a, b = slice(a_at[d], a_at[d + 1]), slice(b_at[d], b_at[d + 1])
        for row in _pieces(a_ids[a], a_end[a], b_ids[b], b_end[b], steps):
            yield d, row
    short = n_a + n_b <= deal
    a_doc, b_doc = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    ka, kb = short[a_doc], short[b_doc]
    a_doc, a_ids, a_end, b_doc, b_ids, b_end = a_doc[ka], a_ids[ka], a_end[ka], b_doc[kb], b_ids[kb], b_end[kb]
    to_b, to_a, shared = merge(a_end, b_end, steps)
    closed = np.cumsum(shared) - shared  # groups closed before each end of B; texts end with a shared end
    a_group = closed[to_b] if len(to_b) else np.zeros(0, np.int64)
    linked = ~shared
    doc = np.concatenate([a_doc, b_doc[linked]])
    pair = np.concatenate([a_ids.astype(np.int64) * enc.ids_b + b_ids[to_b], a_ids[to_a[linked]].astype(np.int64) * enc.ids_b + b_ids[linked]])
    span = enc.ids_a * enc.ids_b
    keys, links = np.unique(doc * span + pair, return_counts=True)
    key_at = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
    groups = np.bincount(b_doc, shared, len(texts)).astype(np.int64)
    n_links = np.bincount(doc, minlength=len(texts))
    made, group_at = written(a_ids, a_group, b_ids, closed, max(enc.ids_a, enc.ids_b))
    first = np.concatenate([[0], np.cumsum(groups)])
    view = memoryview(made.tobytes())
    for d in np.flatnonzero(short):
        k = slice(key_at[d], key_at[d + 1])
        text = view[group_at[first[d]]:group_at[first[d + 1]] - 1] if groups[d] else b""
        yield d, {"n_a": int(n_a[d]), "n_b": int(n_b[d]), "n_groups": int(groups[d]), "n_links": int(n_links[d]),
                  "groups_sha256": hashlib.sha256(text).hexdigest() if groups[d] else "", "pairs": pack_pairs(keys[k] - d * span, links[k])}


def _pieces(a_ids, a_end, b_ids, b_end, steps: int) -> Iterator[dict]:
    """The merge of one text as rows of equal work; each has the open token behind its last one too."""
    total = len(a_end) + len(b_end)
    cuts = np.append(np.arange(0, total, steps), total)
    i, j = merge_path(a_end, b_end, cuts)
    for k in range(len(cuts) - 1):
        before = int(a_end[i[k] - 1]) if i[k] else -1
        yield {"piece": k, "before": before,
               "a_ids": a_ids[i[k]:i[k + 1] + 1].astype("<i4").tobytes(), "a_ends": a_end[i[k]:i[k + 1]].astype("<i8").tobytes(),
               "b_ids": b_ids[j[k]:j[k + 1] + 1].astype("<i4").tobytes(), "b_ends": b_end[j[k]:j[k + 1]].astype("<i8").tobytes()}


def _merged(row: dict, ids_b: int, n_ids: int) -> dict:
    """One piece: its links, its whole groups as text, and the ids before its first and after its last shared end."""
    a_ids, b_ids = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("a_ids", "b_ids"))
    a, b = (np.frombuffer(row[c], "<i8") for c in ("a_ends", "b_ends"))
    to_b, to_a, shared = merge_piece(a, b, row["before"])
    linked = np.flatnonzero(~shared)
    pairs, links = _counted(np.concatenate([a_ids[:len(a)] * ids_b + b_ids[to_b], a_ids[to_a[linked]] * ids_b + b_ids[linked]]))
    closed = np.cumsum(shared) - shared
    ends = int(shared.sum())
    # an A token open at the end of the piece's B ends belongs to what follows the last shared end
    a_group = np.append(closed, ends)[to_b] if len(a) else np.zeros(0, np.int64)
    inside_a, inside_b = (a_group > 0) & (a_group < ends), (closed > 0) & (closed < ends)
    body, _ = written(a_ids[:len(a)][inside_a], a_group[inside_a] - 1, b_ids[:len(b)][inside_b], closed[inside_b] - 1, n_ids)
    part = lambda ids, group, g: ids[:len(group)][group == g].astype("<i4").tobytes()
    return {"rid": row["rid"], "doc_id": row["doc_id"], "piece": row["piece"], "n_a": len(a), "n_b": len(b), "n_groups": ends, "n_links": len(a) + len(linked),
            "pairs": pack_pairs(pairs, links), "open_a": part(a_ids, a_group, 0), "open_b": part(b_ids, closed, 0), "body": body.tobytes(),
            "rest_a": part(a_ids, a_group, ends) if ends else b"", "rest_b": part(b_ids, closed, ends) if ends else b""}


class _Stitch:
    """One text's groups, piece after piece; holds the open group, a hash state and the distinct pairs."""

    def __init__(self, rid: int, doc_id):
        self.rid, self.doc_id, self.hash, self.open_a, self.open_b = rid, doc_id, hashlib.sha256(), [], []
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.total = dict.fromkeys(_TOTALS, 0)
        self.lead = b""  # of the next group

    def add(self, row: dict) -> None:
        for c in self.total:
            self.total[c] += row[c]
        pairs, links = unpack_pairs(row["pairs"])
        self.pairs, self.links = _counted(np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links]))
        self.open_a.append(row["open_a"])
        self.open_b.append(row["open_b"])
        if row["n_groups"]:
            a, b = (",".join(map(str, np.frombuffer(b"".join(x), "<i4").tolist())) for x in (self.open_a, self.open_b))
            self.hash.update(self.lead + f"{a}|{b}".encode())
            if row["body"]:
                self.hash.update(b";" + row["body"][:-1])
            self.lead, self.open_a, self.open_b = b";", [row["rest_a"]], [row["rest_b"]]

    def row(self) -> dict:
        return self.total | {"rid": self.rid, "doc_id": self.doc_id, "groups_sha256": self.hash.hexdigest(), "pairs": pack_pairs(self.pairs, self.links)}


# --- the operator ----------------------------------------------------------------------------------------------------

def _encoded(docs: DataFrame, paths: tuple[str, str, str], steps: int, deal: int) -> DataFrame:
    """One row for each text of at most ``deal`` steps, one for each piece of the others."""
    fields = _WHOLE | _PIECE

    def run(batches):
        enc = Encoders.of(paths)
        for b in batches:
            rid, doc_id, text = (b.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(rid):
                stop, size = at, 0
                while stop < len(rid) and (stop == at or size < SLICE):
                    size += len(text[stop] or "")
                    stop += 1
                out = []
                for d, row in _align(enc, text[at:stop], steps, deal):
                    out.append(row | {"rid": rid[at + d], "doc_id": doc_id[at + d]})
                    if len(out) == 512:
                        yield _batch(b.column(1).type, fields, out)
                        out = []
                if out:
                    yield _batch(b.column(1).type, fields, out)
                at = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ddl(kind, fields))


def _dealt(pieces: DataFrame, ids_a: int, ids_b: int) -> DataFrame:
    """Texts of more steps than ``deal``: their pieces are merged wherever there is room, then stitched in order."""
    def piece(batches):
        for b in batches:
            for row in b.to_pylist():
                yield _batch(b.column("doc_id").type, _MERGED, [_merged(row, ids_b, max(ids_a, ids_b))])

    def stitch(batches):
        text, kind = None, None
        for b in batches:
            kind = b.column("doc_id").type
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if text is None or text.rid != row["rid"]:
                    if text is not None:
                        yield _batch(kind, _WHOLE, [text.row()])
                    text = _Stitch(row["rid"], row["doc_id"])
                text.add(row)
        if text is not None:
            yield _batch(kind, _WHOLE, [text.row()])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    made = pieces.select("rid", "doc_id", *_PIECE).repartition("rid", "piece").mapInArrow(piece, _ddl(kind, _MERGED))
    return made.repartition("rid").sortWithinPartitions("rid", "piece").mapInArrow(stitch, _ddl(kind, _WHOLE))


def _documents_per_pair(texts: DataFrame) -> DataFrame:
    """(pair, docs): in how many texts an id pair is linked; one partial count a task before the shuffle."""
    schema = pa.schema([("pair", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(unpack_pairs(x)[0])
                n += len(held[-1])
                if n > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counted(np.concatenate(held))], schema=schema)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counted(np.concatenate(held))], schema=schema)

    return texts.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _common(counts: DataFrame, frequent: int):
    """The pairs in at least so many texts that no more than ``frequent`` are; the threshold comes from counts per
    eighth of a doubling (a few hundred rows)."""
    step = F.floor(F.log2("docs") * 8)
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    taken, low, all_ = 0, None, sum(n for _, n in sizes)
    for s, n in sizes:
        if taken + n > frequent:
            break
        taken, low = taken + n, s
    if low is None:
        none = np.zeros(0, np.int64)
        return (none, none, none.astype(bool)), counts, all_ == 0
    got = counts.where(step >= low).toArrow()  # at most `frequent` rows
    pair, docs, best = (got.column(c).to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pair)
    return (pair[order], docs[order], best[order]), counts.where(step < low), taken == all_


def _looked_up(texts: DataFrame, common, rest: DataFrame, all_common: bool) -> DataFrame:
    """``texts`` with n_best and count_sum, from the broadcast pairs and a join with the rest."""
    pair, docs, best = common
    kind = texts.schema["doc_id"].dataType.simpleString()
    fields = {c: t for c, t in _WHOLE.items() if c != "pairs"} | {"n_best": "long", "count_sum": "long"}

    def found(made: bytes):
        keys, links = unpack_pairs(made)
        at = np.searchsorted(pair, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(pair)
        hit[inside] = pair[at[inside]] == keys[inside]
        return keys, links, at, hit

    def totals(batches):
        for b in batches:
            n_best, count_sum = [], []
            for made in b.column(b.num_columns - 1).to_pylist():
                _, links, at, hit = found(made)
                at, links = at[hit], links[hit]
                n_best.append(int(links[best[at]].sum()))
                count_sum.append(int((links * docs[at]).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                                             names=["rid", "doc_id", *fields])

    def others(batches):
        for b in batches:
            for rid, made in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, links, _, hit = found(made)
                if not hit.all():
                    n = int((~hit).sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rid)), pa.array(keys[~hit]), pa.array(links[~hit])],
                                                     names=["rid", "pair", "links"])

    out = texts.select("rid", "doc_id", *_WHOLE).mapInArrow(totals, _ddl(kind, fields))
    if all_common:
        return out.drop("rid")
    more = (texts.select("rid", "pairs").mapInArrow(others, "rid long, pair long, links long").join(rest, "pair")
            .groupBy(F.col("rid").alias("r_id")).agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("b"),
                                                     F.sum(F.col("links") * F.col("docs")).alias("c")))
    return (out.join(more, F.col("rid") == F.col("r_id"), "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))})
            .select("doc_id", *fields))


def align(docs: DataFrame, paths: tuple[str, str, str] | None = None, steps: int = STEPS, deal: int = DEAL,
          frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Align the tokens of every text of ``docs(doc_id, text)``.

    Returns one row per text (doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    n_best, count_sum) and the corpus's linked id pairs (a_id, b_id, docs, best)."""
    paths = paths or tokenizer_paths()
    enc = Encoders.of(paths)
    made = materialize(_encoded(docs, paths, steps, deal), "encoded")
    whole = made.where("piece is null").select("rid", "doc_id", *_WHOLE)
    long_ = made.where("piece is not null")
    if not long_.isEmpty():
        whole = whole.unionByName(materialize(_dealt(long_, enc.ids_a, enc.ids_b), "stitched"))
    a_id = F.floor(F.col("pair") / F.lit(enc.ids_b))
    counts = _documents_per_pair(whole).withColumn("a_id", a_id)
    counts = materialize(counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a_id"))), "pair-counts")
    common, rest, all_common = _common(counts, frequent)
    rows = _looked_up(whole, common, rest.select("pair", "docs", "best"), all_common)
    return rows, counts.select("a_id", (F.col("pair") % F.lit(enc.ids_b)).alias("b_id"), "docs", "best")


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``DIGEST``."""
    return align(docs)[0].select("doc_id", *DIGEST)
