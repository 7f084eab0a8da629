"""BPE encoding by a pair occurrence index, and decoding.

All words of a block of texts, repeated ones included, stand one after another in one array of symbols
with links to the next and previous symbol. An index maps each active pair (one that has a merge rank)
to all its positions. The lowest active rank is applied at all its positions at once; only the pairs
beside the merged symbols change, and those are added to the lists of their ranks. This equals the usual
word-by-word loop if every merge has a higher rank than those that make its two sides, which is
checked when the model is loaded. What is left of the array are the texts' ids; decoding reads the ids.

Texts are cut at ASCII white space; each distinct piece of a block is normalised and split into words by
the tokenizer file's own normalizer and pre-tokenizer. Strings of special tokens inside a text become
their ids, as the library does by default.

Defined cases: a null or empty text has no ids and decodes to an empty string; a text longer than a block
goes through the index in parts, cut at white space; every row gives one row, whatever its id; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from aislewise.llm.common import arrow_schema, columns_of

#: Pieces of printable ASCII and Latin-1 letters need no library call if the file has ``PLAIN_SPEC``:
#: they are composed already, and lower case and the pattern are those of Python.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")
#: Byte-level letters: printable bytes are themselves, the others follow from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}
#: The normalizer and pattern for which the short cut holds.
PLAIN_SPEC = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


class PairIndexBPE:
    """Encoder and decoder for a ``tokenizers`` file with a BPE model and byte-level pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # Only its normalizer and pre-tokenizer are called: without the vocabulary it takes no memory.
        bare = {"vocab": {}, "merges": []}
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": model | bare, "added_tokens": []}))
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models without byte fallback, dropout, prefixes and ignore_merges")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("only files without a decoder and post-processor")
        normal, split = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.plain = normal.get("normalizers") == PLAIN_SPEC["normalizers"] and (split[0].get("pattern"), split[0].get("behavior"), split[0].get("invert")) == ({"Regex": PLAIN_SPEC["pattern"]}, "Removed", True) and split[1].get("type") == "ByteLevel"
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        made_at: dict[int, int] = {}
        for rank, token in enumerate(self.made.tolist()):
            made_at[token] = max(rank, made_at.get(token, -1))
        if any(made_at.get(x, -1) >= rank for rank, pair in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)) for x in pair):
            raise ValueError("a merge comes before the merge that makes one of its sides")
        self.base = np.int64(max(vocab.values()) + 2)  # one value more: -1 behind a symbol is no pair
        keys = self.left * self.base + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.byte = {chr(_BYTE_LETTERS.get(b, b)): b for b in range(0x100)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_in = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([self.token.get(i) for i in range(max(self.token) + 1)], pa.string())
        # What texts start as: a byte within a word, a word's last byte (256 more), a special token (from 512 on).
        self.special_code = {t: 512 + i for i, t in enumerate(self.special)}
        self.unit = np.array([*(vocab.get(c, -1) for c in self.byte), *(vocab.get(c + suffix, -1) for c in self.byte), *self.special.values()], np.int32)
        self.none = len(merges)  # rank of a pair that no merge joins
        self.rank_type = np.uint16 if self.none < 1 << 16 else np.int32  # numpy sorts short integers faster
        self.unit_ranks = np.stack([self._ranks(a, self.unit) for a in self.unit])

    # -- merging ---------------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], self.none).astype(self.rank_type)

    def merge(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply all merges to words that stand one after another. Returns the ids, and at which places
        of ``codes`` a symbol is left."""
        n = len(codes)
        sym = np.empty(n + 1, np.int32)  # -1 where a symbol was merged into the one before, and at n: no symbol
        sym[:n], sym[n] = self.unit[codes], -1
        if (sym[:n] < 0).any():
            raise ValueError("a byte is missing in the vocabulary")
        ends = codes >= 256
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[:n][ends] = n
        prv[1:][ends] = prv[0] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            some = np.flatnonzero(rank != self.none)
            if not len(some):
                return
            at, rank = at[some], rank[some]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, begin, end in zip(rank[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[begin:end])

        pairs = np.flatnonzero(~ends[:-1]).astype(np.int32) if n else np.empty(0, np.int32)
        add(pairs, self.unit_ranks[codes[pairs], codes[pairs + 1]])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            to = nxt[at]
            good = (sym[at] == a) & (sym[to] == b)
            at, to = at[good], to[good]
            if a == b and len(at) > 1:  # runs such as aaa: from the left, none twice
                taken, keep = -1, []
                for i, (p, q) in enumerate(zip(at.tolist(), to.tolist(), strict=True)):
                    if p != taken:
                        keep.append(i)
                        taken = q
                at, to = at[keep], to[keep]
            if not len(at):
                continue
            after = nxt[to]
            sym[at] = self.made[rank]
            sym[to] = -1
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            beside = before != n
            beside[1:] &= before[1:] != at[:-1]  # merged itself: stands in ``at``
            changed = np.concatenate([before[beside], at[after != n]])
            add(changed, self._ranks(sym[changed], sym[nxt[changed]]))
        left = sym[:n] >= 0
        return sym[:n][left], left

    # -- words and texts -------------------------------------------------------------------------

    def _pretokens(self, text: str) -> list[bytes]:
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def codes_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of pieces (texts without ASCII white space): the codes of all their bytes, and where
        each piece's begin and end."""
        begins, ends = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        codes = [np.empty(0, np.uint16)]
        plain = [i for i, p in enumerate(pieces) if self.plain and _PLAIN.fullmatch(p) and not ("<|" in p)]
        if plain:  # all in one pass, with line ends between the pieces, and a zero behind each word
            found = _PLAIN_WORDS.findall("\n".join([pieces[i] for i in plain]).lower())
            data = np.frombuffer(("\0".join(found) + "\0").encode(), np.uint8)
            letter = data > 10
            at = np.flatnonzero(letter)
            codes.append(data[at] + np.uint16(256) * (data[at + 1] == 0))
            ends[plain] = np.r_[np.cumsum(letter)[data == 10], len(at)]
            begins[plain] = np.r_[0, ends[plain][:-1]]
        done = len(codes[-1])
        words: list[bytes] = []
        special: list[tuple[int, int]] = []  # word and code
        counts = []
        others = sorted(set(range(len(pieces))).difference(plain))
        for i in others:
            for x in self.special_in.split(pieces[i]) if self.special_in else [pieces[i]]:
                if x in self.special:
                    special.append((len(words), self.special_code[x]))
                    words.append(b"\0")
                elif x:
                    words.extend(self._pretokens(x))
            counts.append(len(words))
        if words:
            stops = np.cumsum([len(w) for w in words])
            rest = np.frombuffer(b"".join(words), np.uint8).astype(np.uint16)
            rest[stops - 1] += 256
            for word, code in special:
                rest[stops[word] - 1] = code
            codes.append(rest)
            ends[others] = done + np.r_[0, stops][counts]
            begins[others] = np.r_[done, ends[others][:-1]]
        return np.concatenate(codes), begins, ends

    def encode_block(self, texts: pa.Array, part: int = 1_500_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end. All words of up to ``part`` bytes (or a longer
        piece) are indexed at a time."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes, begins, ends = self.codes_of(coded.dictionary.to_pylist())
        numbers = coded.indices.to_numpy()
        sizes = (ends - begins)[numbers]
        stops = np.r_[0, np.cumsum(sizes)]
        offsets = split.offsets.to_numpy()
        text_stops = stops[offsets[1:] - offsets[0]]
        id_ends = np.zeros(len(texts), np.int64)
        ids, n_ids, first = [np.empty(0, np.int32)], 0, 0
        while first < len(numbers):
            done = stops[first]
            end = max(first + 1, int(np.searchsorted(stops, done + part, side="right")) - 1)
            place = np.repeat((begins[numbers[first:end]] - (stops[first:end] - done)).astype(np.int32), sizes[first:end])
            place += np.arange(len(place), dtype=np.int32)
            found, left = self.merge(codes[place])
            mine = (text_stops > done) & (text_stops <= stops[end])
            id_ends[mine] = n_ids + np.cumsum(left, dtype=np.int32)[text_stops[mine] - done - 1]
            ids.append(found)
            n_ids, first = n_ids + len(found), end
        return np.concatenate(ids), id_ends

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens, joined by blanks."""
        return " ".join([self.token[int(i)] for i in ids if int(i) in self.token])

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The same for the ids of several texts, which end at ``ends``."""
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), block_chars: int = 1_500_000) -> DataFrame:
    """One row per input row: ``id`` and the wanted ``columns`` of ``n_tokens``, ``ids``, ``decoded``,
    ``ids_sha256`` and ``decoded_sha256``. Narrow: no shuffle. A task holds a block of about
    ``block_chars`` bytes of texts (at least one text) at a time, with the index of all its words."""
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = f"id {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches):
        bpe = PairIndexBPE(path)
        held, chars = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                held.append(part)
                chars += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if chars >= block_chars:
                    yield from block(bpe, held)
                    held, chars = [], 0
            held = [pa.RecordBatch.from_pydict(b.to_pydict(), schema=b.schema) for b in held]  # not slices that keep the batch
        if held:
            yield from block(bpe, held)

    def block(bpe, held):
        rows = pa.Table.from_batches(held)
        keys = rows.column(0).combine_chunks()
        ids, ends = bpe.encode_block(pc.fill_null(rows.column(1).combine_chunks(), ""), block_chars)
        for i in range(0, len(keys), 256):  # the result goes out in slices
            begin = int(ends[i - 1]) if i else 0
            part = ends[i : i + 256] - begin
            yield slice_of(bpe, keys[i : i + 256], ids[begin : begin + int(part[-1])], part)

    def slice_of(bpe, keys, ids, ends):
        data = memoryview(ids.astype("<u4").tobytes())
        out = {"id": keys, "n_tokens": np.diff(ends, prepend=0)}
        if "ids" in columns:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
        if "ids_sha256" in columns:
            out["ids_sha256"] = [hashlib.sha256(data[4 * b : 4 * e]).hexdigest() for b, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        if "decoded" in columns or "decoded_sha256" in columns:
            out["decoded"] = bpe.decode_lists(ids, ends)
        if "decoded_sha256" in columns:
            out["decoded_sha256"] = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in out["decoded"]]
        return pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return columns_of(df, id_col, text_col).mapInArrow(run, schema)
