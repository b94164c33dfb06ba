"""Tokenizing by parts: a text is cut where its tokenizer cuts anyway, and each part's ids are kept.

The ids of a part always come from the tokenizers library. A text for which
the cut isn't proven safe is given to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Bytes that a generation of a worker's cache may take, about; two are held.
CACHE_BYTES = 48 << 20
#: Bytes of an entry beside its part and its value.
ENTRY_BYTES = 180
#: Longer parts are encoded but not kept.
KEPT_CHARS = 64
#: Characters that the library encodes at once, but for a longer block: what it returns takes some 200 bytes a token.
AT_ONCE = 100_000


def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would hold memory of its own
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Layout:
    """How a tokenizer file cuts texts: "space" before each space (byte-level), "words" at white space, else "whole"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.wide = len(spec["model"]["vocab"]) + len(self.special) > 65536
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "space"
        elif pre.get("type") == "Sequence" and norm.get("type") == "Sequence":
            first = pre["pretokenizers"][0]
            split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
            drops_space = split and re.search(r"\[\^\\s\\p\{L\}\\p\{N\}\]\+$", first["pattern"].get("Regex", ""))
            plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+") for n in norm["normalizers"])
            if drops_space and plain and not any(" " in s or "\n" in s for s in self.special):
                self.kind = "words"


_ODD = re.compile(r"\s (?:\s|\Z)|[^\S\n]\n")


def cuts_before_spaces(text: str) -> bool:
    """Whether each space and each run of line breaks starts a part of its own.

    Not so where a space has white space before it and white space or the end
    after it, or where other white space stands before a line break: the
    byte-level pattern cuts such runs elsewhere.
    """
    if "  " not in text and "\n " not in text and " \n" not in text and text.replace("\n", "").isprintable():  # no other white space
        return True
    return _ODD.search(text) is None


#: Punctuation that ends a part after a letter is a pre-token of its own.
ENDINGS = ".,!?;:"
#: Missing words that are encoded as one text.
JOINED = 200


def latin_word(part: str) -> bool:
    """Letters below U+0100 alone: one pre-token that no normal form changes."""
    return part.isalpha() and (part.isascii() or max(part) < "\u0100")


def encoded(tokenizer, texts: list[str]):
    """The ids of each text, AT_ONCE characters at a time."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
            size += len(texts[end])
            end += 1
        for got in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
            yield got.ids
        at = end


class Generations:
    """Values of parts, bounded by bytes: what wasn't used since the last turn but one is forgotten."""

    def __init__(self, pinned: dict | None = None):
        self.pinned, self.new, self.old, self.held = pinned or {}, dict(pinned or {}), {}, 0

    def lookup(self, parts: list[str], compute) -> list:
        """Values of parts; compute(missing) gives a dict of those that aren't held."""
        if self.held > CACHE_BYTES:
            self.old, self.new, self.held = self.new, dict(self.pinned), 0
        new, old = self.new, self.old
        found = list(map(new.get, parts))
        gaps = [k for k, v in enumerate(found) if v is None]
        missing = []
        for k in gaps:
            p = parts[k]
            v = old.get(p)
            if v is None:
                missing.append(p)
            else:
                new[p] = found[k] = v
                self.held += ENTRY_BYTES
        if missing:
            made = compute(missing)
            for k in gaps:
                if found[k] is None:
                    found[k] = made[parts[k]]
            kept = {p: v for p, v in made.items() if len(p) <= KEPT_CHARS}
            new.update(kept)
            self.held += ENTRY_BYTES * len(kept) + sum(map(len, kept))
        return found


def distinct_parts(texts: list[str], pattern: str, replacement: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct parts between spaces, index of each part, first part of each text and the end), after a replacement."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.replace_substring_regex(pa.array(texts, pa.large_string()), pattern, replacement)
    cut = pc.split_pattern(column, " ")
    coded = pc.dictionary_encode(cut.values)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), cut.offsets.to_numpy()


class PieceCoder:
    """ids of whole texts, by parts; a part is a space and what follows it up to the next."""

    def __init__(self, path: str):
        self.layout, self.tokenizer = Layout(path), library_tokenizer(path)
        self.dtype = np.dtype("<u4" if self.layout.wide else "<u2")
        self.first, self.rest = Generations(), Generations()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True  # how byte-level files write a space
        self.broken = np.zeros(len(self.spaced), bool)
        self.broken[[i for token, i in vocab.items() if token.startswith("\u010a")]] = True  # and a line break

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _joined(self, parts: list[str], lead: str, starts_part: np.ndarray) -> dict[str, bytes]:
        """Parts after a lead character, many in one text: the lead of each marks its first token."""
        out, width = {}, self.dtype.itemsize
        blocks = [parts[at : at + JOINED] for at in range(0, len(parts), JOINED)]
        for block, got in zip(blocks, encoded(self.tokenizer, [lead + lead.join(b) for b in blocks]), strict=True):
            ids = np.array(got, self.dtype)
            starts = np.flatnonzero(starts_part[ids])
            if len(starts) != len(block):
                out.update((p, self.whole(lead + p)) for p in block)
                continue
            raw, cuts = ids.tobytes(), (np.append(starts, len(ids)) * width).tolist()
            out.update((p, raw[i:j]) for p, i, j in zip(block, cuts, cuts[1:], strict=False))
        return out

    def _rest(self, missing: list[str]) -> dict[str, bytes]:
        """Missing parts: after a space, or after the line breaks that they start with."""
        plain = [p for p in missing if p and p.isprintable()]
        lines = [p[1:] for p in missing if p and p[0] == "\n" and len(p) > 1 and p[1:].isprintable()]
        out = self._joined(plain, " ", self.spaced)
        out.update(("\n" + p, v) for p, v in self._joined(lines, "\n", self.broken).items())
        for p in missing:
            if p not in out:
                out[p] = self.whole(p if p[:1] == "\n" else " " + p)
        return out

    def _first(self, missing: list[str]) -> dict[str, bytes]:
        return {p: self.whole(p) for p in missing}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); a missing text has none."""
        safe = [k for k, t in enumerate(texts) if t and self.layout.kind == "space" and not any(s in t for s in self.layout.special) and cuts_before_spaces(t)]
        parts, index, offsets = distinct_parts([texts[k] for k in safe], "\n+", r" \0")
        values = self.rest.lookup(parts, self._rest)
        heads = [texts[k].split(" ", 1)[0].split("\n", 1)[0] for k in safe]
        values += self.first.lookup(heads, self._first)
        index = index.astype(np.int64)
        index[offsets[:-1]] = len(parts) + np.arange(len(safe))
        # Texts that the library takes whole are one part each.
        known = set(safe)
        other = [k for k in range(len(texts)) if texts[k] and k not in known]
        values += [self.whole(texts[k]) for k in other]
        extra = len(parts) + len(safe) + np.arange(len(other))
        sizes = np.zeros(len(texts), np.int64)
        sizes[safe] = np.diff(offsets)
        sizes[other] = 1
        slots = np.empty(int(sizes.sum()), np.int64)
        where = np.cumsum(sizes) - sizes
        if len(safe):
            slots[np.repeat(where[safe] - offsets[:-1], np.diff(offsets)) + np.arange(len(index))] = index
        slots[where[other]] = extra
        lens = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(values), self.dtype)
        starts = np.cumsum(lens) - lens
        n = lens[slots]
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]) if len(ends) else 0)
        place += np.repeat(starts[slots] - (ends - n), n)
        flat = pool[place]
        upto = np.append(0, ends)
        edges = np.append(where, len(slots))
        return flat, upto[edges[1:]] - upto[edges[:-1]]


class PieceCounter:
    """Numbers of tokens of whole texts: a pinned table of frequent parts, then a bounded cache."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.layout, self.tokenizer = Layout(path), library_tokenizer(path)
        self.cache = Generations(frequent)
        self.sentinel = self.tokenizer.encode("\x7f", add_special_tokens=False).ids

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else 0

    def compute(self, missing: list[str]) -> dict[str, int]:
        """Words by joined texts, in which a mark of one token ends each; then words with an ending; then all others."""
        words, cut, out = set(), [], {}
        for p in missing:
            stem = p.rstrip(ENDINGS)
            if latin_word(stem) and len(self.sentinel) == 1:
                words.add(stem)
                if stem != p:
                    cut.append((p, stem, p[len(stem) :]))
            else:
                out[p] = self.whole(p)
        held, marks = self.cache.new, {}
        todo = [w for w in words if w not in held]
        blocks = [todo[at : at + JOINED] for at in range(0, len(todo), JOINED)]
        for block, got in zip(blocks, encoded(self.tokenizer, [" \x7f ".join(b) + " \x7f" for b in blocks]), strict=True):
            ends = np.flatnonzero(np.array(got) == self.sentinel[0])
            out.update(zip(block, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
        for p, stem, end in cut:
            if end not in marks:
                marks[end] = self.whole(end)
            out[p] = (out[stem] if stem in out else held[stem]) + marks[end]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Parts are what stands between ASCII blanks; a file that isn't known to cut there gets whole texts."""
        out = np.zeros(len(texts), np.int64)
        safe = [k for k, t in enumerate(texts) if t and self.layout.kind == "words" and not any(s in t for s in self.layout.special)]
        if safe:
            parts, index, offsets = distinct_parts([texts[k] for k in safe], "\n", " ")
            counts = np.array(self.cache.lookup(parts, self.compute), np.int64)
            upto = np.append(0, np.cumsum(counts[index]))
            out[safe] = upto[offsets[1:]] - upto[offsets[:-1]]
        for k in sorted({k for k, t in enumerate(texts) if t}.difference(safe)):
            out[k] = self.whole(texts[k])
        return out.tolist()


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """This worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = PieceCoder(path)
    return _coders[path]
