"""Token ids of whole texts, in Arrow batches, with a byte-level BPE file of the ``tokenizers`` library.

That vocabulary's pre-tokenizer never joins what stands on both sides of a single blank or line feed, except that a blank belongs to the word after
it.  So a text can be cut there, each distinct piece encoded once per task, and the ids put together again by numpy.  Texts with three white-space
characters in a row, or two at the end, and texts that hold the string of a special token (which the library turns into that token's id) are the exception
and are encoded whole; the ids are the library's either way.  A very long text is cut like any other; one that must be encoded whole is held whole.
"""

from __future__ import annotations

import os
import string
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the white-space characters of the vocabulary's pre-tokenizer.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNCUT = f"{SPACE}{SPACE}{SPACE}|{SPACE}{SPACE}\\z"
PREFIXES = ("", "\n", " ")

#: Pieces that a worker remembers (beyond them only those met again since they were learnt stay, half as many at most; about 200 bytes each) and the longest piece worth it.
MEMORY = 400_000
LONGEST = 64
#: New words that the library encodes together, as one text; more gain nothing.
TOGETHER = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes that each id stands for: a byte-level vocabulary writes one character per byte.
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes, self.again = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def _forget(self) -> None:
        """Keep the pieces met again since the last time, as far as they fill at most half of the memory."""
        pieces, places = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        stay = self.again[places]
        stay &= np.cumsum(stay) <= self.memory // 2
        kept = places[stay]
        ids, sizes = self._gather(kept)
        self.pool, self.sizes, self.starts, self.again = ids, sizes, np.cumsum(sizes) - sizes, np.zeros(len(kept), bool)
        self.known = dict(zip(compress(pieces, stay.tolist()), range(len(kept)), strict=True))

    def _whole(self, texts: list[str], special: bool = False) -> list[list[int]]:
        """Ids of texts as the library gives them; without ``special`` (texts that hold no special token) it need not look for those."""
        self.tokenizer.encode_special_tokens = not special
        out = []
        for at in range(0, len(texts), 256):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + 256], add_special_tokens=False)]
        self.tokenizer.encode_special_tokens = False
        return out

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and each piece's count.

        Words behind a blank are encoded many at once, as one text: there is a cut before every blank, and the bytes of the ids tell where a word ends.
        Other pieces, and words for which the bytes do not tell, are encoded one by one.
        """
        words = pa.array(pieces, pa.string())
        bare = pc.and_(pc.match_substring_regex(words, r"\A [^ ]"), pc.invert(pc.match_substring_regex(pc.utf8_slice_codeunits(words, 1), SPACE)))
        alone = ~bare.to_numpy(zero_copy_only=False)
        together = np.flatnonzero(~alone)
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = [together[at:at + TOGETHER] for at in range(0, len(together), TOGETHER)]
        sizes, found = np.zeros(len(pieces), np.int64), []
        texts = ["".join(pieces[i] for i in group.tolist()) for group in groups]
        for group, ids in zip(groups, self._whole(texts), strict=True):
            ids = np.array(ids, np.uint32)
            upto, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(lengths[group])
            last = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] == ends[-1] and (upto[last] == ends).all():
                sizes[group] = np.diff(last, prepend=-1)
                found.append(ids)
            else:
                alone[group] = True
        own = self._whole(list(compress(pieces, alone.tolist())))
        sizes[alone] = list(map(len, own))
        out, mine = np.empty(int(sizes.sum()), np.uint32), np.repeat(alone, sizes)
        out[~mine] = np.concatenate([np.empty(0, np.uint32), *found])
        out[mine] = _flat(own)
        return out, sizes

    def _learn(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Index of each piece in the pool, encoding those not yet known.

        Between a letter and ASCII punctuation there is always a cut, so a piece that ends in punctuation is put together from its stem and tail.
        """
        if len(self.known) > self.memory:
            self._forget()
        known = self.known
        places = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        self.again[places[places >= 0]] = True
        if not len(missing):
            return places
        new, joined, parts, plain = [pieces[i] for i in missing.tolist()], [], [], {}
        for piece in new:
            stem = piece.rstrip(string.punctuation)
            if stem and len(stem) < len(piece) and stem[-1].isalpha():
                tail = piece[len(stem):]
                joined.append(piece)
                parts += stem, tail
                if stem not in known:
                    plain[stem] = None
                if tail not in known:
                    plain[tail] = None
            else:
                plain[piece] = None
        if plain:
            self._learn(list(plain), *self._pieces(list(plain)))
        if joined:
            ids, sizes = self._gather(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
            self._learn(joined, ids, sizes.reshape(-1, 2).sum(axis=1))
        places[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        for piece in [p for p in chain(plain, joined) if len(p) > LONGEST]:
            del known[piece]
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's count. Null is an empty text, without ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        uncut = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        for token in self.special:
            uncut = uncut | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        lines = pc.split_pattern(pc.if_else(pa.array(uncut), "", texts) if uncut.any() else texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        in_text, in_line = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (lines, words))
        coded = words.flatten().dictionary_encode()
        line_ends = np.cumsum(in_line)
        kind = np.full(int(line_ends[-1]) if len(line_ends) else 0, 2, np.int64)
        text_lines = np.cumsum(in_text)
        kind[line_ends - in_line] = 1
        kind[(line_ends - in_line)[text_lines - in_text]] = 0
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 3 + kind
        seen = np.zeros(3 * len(coded.dictionary), bool)
        seen[key] = True
        used = np.flatnonzero(seen)
        words_used = coded.dictionary.take(pa.array(used // 3)).to_numpy(zero_copy_only=False).tolist()
        place = np.zeros(len(seen), np.int64)
        place[used] = self._places([PREFIXES[k] + s for k, s in zip((used % 3).tolist(), words_used, strict=True)])
        at = place[key]
        ids, sizes = self._gather(at)
        upto = np.concatenate([[0], np.cumsum(sizes)])[line_ends[text_lines - 1]]
        counts = np.diff(upto, prepend=0)
        if not uncut.any():
            return ids, counts
        own = self._whole(texts.filter(pa.array(uncut)).to_pylist(), special=True)
        counts[uncut] = [len(x) for x in own]
        out = np.empty(int(counts.sum()), np.uint32)
        mine = np.repeat(uncut, counts)
        out[~mine] = ids
        out[mine] = _flat(own)
        return out, counts

    def documents(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Like ``encode``, with the end id after each text."""
        ids, counts = self.encode(texts)
        if end is None:
            return ids, counts
        total = counts + 1
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        last = np.zeros(len(out), bool)
        last[ends - 1] = True
        out[last], out[~last] = end, ids
        return out, total


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One per Python worker: loading the vocabulary takes longer than a batch."""
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = Encoder(path, memory)
    return _ENCODERS[path, memory]
