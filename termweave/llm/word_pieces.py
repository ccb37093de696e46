"""Ids of texts by way of pieces that are encoded once: for tokenizers that begin a token at every single blank or line end."""

from __future__ import annotations

import json
import os
import re
import sys
import threading
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers

from termweave.llm.common import give_back

IDLE_SECONDS = 8
TOGETHER = 100  # new pieces encoded as one text
SLICE = 1 << 18  # characters cut into pieces at a time; bounds the memory that a long text takes, with its ids
MARKS = (" ", "\n")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-я]+")  # letters in all versions of Unicode
MARKED = re.compile(rf"(\n?{LETTERS.pattern})([!-/:-@\[-`{{-~]{{1,4}})")  # letters, and signs behind them
BORDER = re.compile(r"(?<=\S) (?=[^\s▁])")


class Coder:
    """``encode`` gives the ids of texts; ``words`` does so for texts of words of ``LETTERS``, each after a blank; ``opens`` marks, per blank and
    line end, the ids whose token begins with it; ``parts`` tells that signs behind the letters of a word have the ids that they have alone.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], opens: dict[str, np.ndarray], tokens: list[bytes], words=None, parts: bool = False):
        self.encode, self.opens, self.tokens, self.words, self.parts = encode, opens, tokens, words or encode, parts
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))


def file_of(name: str) -> str:
    """``name`` itself if it is a path, else the place of the public vocabulary of that name."""
    return name if os.path.sep in name else public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The byte behind each character of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        shown[chr(256 + i)] = b
    return shown


def _opens(tokens: list[bytes]) -> dict[str, np.ndarray]:
    return {mark: np.array([t.startswith(mark.encode()) for t in tokens]) for mark in MARKS}


def _letter_words(tokenizer: Tokenizer, parts: dict) -> Callable[[list[str]], list[list[int]]] | None:
    """Encoder of texts of words of ``LETTERS``: the same model, given the words cut at the blanks and in their byte characters, without the general
    cutting of texts; None where the vocabulary does more than that.
    """
    cutter = parts["pre_tokenizer"] or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
    if not plain or any(parts[k] for k in ("normalizer", "truncation", "padding")) or any(LETTERS.fullmatch(t["content"].strip()) for t in parts["added_tokens"]):
        return None
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    shown = {b: c for c, b in byte_characters().items()}
    shown[32] = blank = " " + shown[32]

    def run(texts: list[str]) -> list[list[int]]:
        cut = [t.replace(" ", blank) if t.isascii() else t.encode().decode("latin-1").translate(shown) for t in texts]
        return [e.ids for e in bare.encode_batch_fast(cut, add_special_tokens=False)]

    return run


def _signs_apart(parts: dict) -> bool:
    """Whether no added token can take letters together with the signs behind them, or depends on what stands beside it; for vocabularies that
    ``_letter_words`` takes, whose cutting ends letters before a sign.
    """
    return all(MARKED.fullmatch("a" + t["content"][:1]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in parts["added_tokens"])


def byte_level_coder(name: str, special: bool = True) -> Coder:
    """A byte-level vocabulary file; strings of special tokens in texts are plain text unless ``special``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(file_of(name))
    tokenizer.encode_special_tokens = not special
    vocabulary, byte_of = tokenizer.get_vocab(), byte_characters()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    # The call that does not work out offsets.
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    parts = json.loads(tokenizer.to_str())
    words = _letter_words(tokenizer, parts)
    return Coder(encode, _opens(tokens), tokens, words, words is not None and _signs_apart(parts))


def piece_coder(name: str) -> Coder:
    """A sentence-piece model that puts a blank before every text; texts are given with that blank."""
    model = sentencepiece.SentencePieceProcessor(model_file=file_of(name))
    tokens = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    if any(b" " in t.lstrip(b" ") for t in tokens):
        raise ValueError("this model has pieces with a blank inside")
    return Coder(lambda texts: model.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1), _opens(tokens), tokens)


def slices(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before single blanks at which a piece starts; one part where there are none."""
    start = 0
    while border := BORDER.search(text, start + size):
        yield text[start : border.start()]
        start = border.start()
    yield text[start:] if start else text


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """``values`` with room for ``more`` behind the first ``used`` and at least one zero behind those; doubled, so that they are seldom copied."""
    if used + more < len(values):
        return values
    out = np.zeros(max(2 * len(values), used + more + 1), values.dtype)
    out[:used] = values[:used]
    return out


class PieceCache:
    """Ids of texts in one or several vocabularies by way of pieces that start at single blanks or line ends before other characters.

    There a new token begins in every one of the vocabularies, so the pieces can be encoded alone and their ids joined. A text with
    runs of white space is encoded whole, a long one in slices that are cut before such pieces. Of more than ``limit`` pieces those met again stay, at most half of ``limit``, the most
    frequent ones; pieces seen in one batch only are dropped.

    Where all vocabularies allow it (``Coder.parts``), a new piece of letters and signs behind them takes the ids of both, which are pieces of their
    own; signs are kept with a blank before them, which no piece of a text has.
    """

    def __init__(self, coders: list[Coder], limit: int = 300_000, size: int = SLICE):
        self.coders, self.limit, self.size = coders, limit, size
        self.known: dict[str, int] = {}
        self.parts = all(c.parts for c in coders)
        # Arrays have room at their end. Place -1, of pieces that cannot stand alone, is the last one, which stays empty.
        self.places, self.ids = 1, [0 for _ in coders]
        self.flat = [np.zeros(1, np.int32) for _ in coders]
        self.starts, self.lengths = ([np.zeros(2, np.int64) for _ in coders] for _ in range(2))
        self.hits = np.zeros(2, np.int64)

    def _forget(self):
        again = np.flatnonzero(self.hits[: self.places])
        most = self.limit // 2
        if len(again) > most:
            again = np.sort(again[np.argpartition(-self.hits[again], most)[:most]])
        place = np.full(len(self.hits), -1, np.int64)
        place[again] = np.arange(1, len(again) + 1)
        names = list(self.known)
        old = np.fromiter(self.known.values(), np.int64, len(names))
        new = np.where(old >= 0, place[old], -1)
        self.known = {names[i]: p for i, p in zip(np.flatnonzero(new > 0).tolist(), new[new > 0].tolist())}
        for c in range(len(self.coders)):
            lengths = self.lengths[c][again]
            ends = np.cumsum(lengths)
            at = np.repeat(self.starts[c][again] - ends + lengths, lengths)
            self.flat[c] = self.flat[c][at + np.arange(len(at))]
            self.ids[c] = len(at)
            self.starts[c], self.lengths[c] = (np.concatenate([[0], x, [0]]) for x in (ends - lengths, lengths))
        self.places = len(again) + 1
        self.hits = np.zeros(self.places + 1, np.int64)

    def _add(self, ids: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Places for new pieces, given for each vocabulary all their ids and how many each has."""
        n, place = len(lengths[0]), self.places
        for c in range(len(self.coders)):
            used, more = self.ids[c], len(ids[c])
            self.flat[c] = _room(self.flat[c], used, more)
            self.flat[c][used : used + more] = ids[c]
            self.starts[c], self.lengths[c] = (_room(x, place, n) for x in (self.starts[c], self.lengths[c]))
            self.starts[c][place : place + n] = used + np.cumsum(lengths[c]) - lengths[c]
            self.lengths[c][place : place + n] = lengths[c]
            self.ids[c] += more
        self.hits = _room(self.hits, place, n)
        self.places += n
        return np.arange(place, place + n)

    def _ids_at(self, c: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places one after another, and how many each has."""
        lengths = self.lengths[c][k]
        at = np.repeat(self.starts[c][k] - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[c][at], lengths

    def _learn(self, new: list[str]) -> None:
        """Take up new pieces: those of letters and signs after their parts."""
        marked, both = [], []
        if self.parts:
            rest, parted = [], MARKED.fullmatch
            for w in new:
                if found := parted(w):
                    marked.append(w)
                    both += found[1], " " + found[2]
                else:
                    rest.append(w)
            new = list(dict.fromkeys(chain(rest, (w for w in both if w not in self.known))))
        self._learn_alone(new)
        if marked:
            k = np.fromiter(map(self.known.__getitem__, both), np.int64, len(both))
            np.add.at(self.hits, k, 1)
            found = [self._ids_at(c, k) for c in range(len(self.coders))]
            places = self._add([ids for ids, _ in found], [lengths[::2] + lengths[1::2] for _, lengths in found])
            self.known.update(zip(marked, places.tolist()))

    def _learn_alone(self, new: list[str]) -> None:
        """Encode new pieces, many in a text. A piece begins where an id's token begins with its blank or line end."""
        words, blank, line, signs = [], [], [], []
        letters = LETTERS.fullmatch
        for i, w in enumerate(new):
            if letters(w):
                words.append(i)
            elif not w or "▁" in w:
                continue
            elif w[0] == " ":
                signs.append(i)
            elif not w[0].isspace():
                blank.append(i)
            elif w[0] == "\n" and len(w) > 1 and not w[1].isspace():
                line.append(i)
        places = np.full(len(new), -1, np.int64)
        for mark, members in ((" ", words), (" ", blank), ("\n", line)):
            group = [new[i] for i in members]
            if not group:
                continue
            glue = "" if mark == "\n" else " "
            joined = [glue + glue.join(group[i : i + TOGETHER]) for i in range(0, len(group), TOGETHER)]
            ids, lengths = [], []
            for coder in self.coders:
                found = [np.asarray(x, np.int32) for x in (coder.words if members is words else coder.encode)(joined)]
                # What stands before a text's first piece, as the blank that a model puts there, is no piece's.
                ids.append(np.concatenate([x[np.argmax(coder.opens[mark][x]) :] for x in found]))
                begins = np.flatnonzero(coder.opens[mark][ids[-1]])
                if len(begins) != len(group):
                    raise ValueError("this vocabulary does not begin a token at each blank and line end")
                lengths.append(np.diff(np.append(begins, len(ids[-1]))))
            places[members] = self._add(ids, lengths)
        if signs:
            found = [coder.encode([new[i][1:] for i in signs]) for coder in self.coders]
            places[signs] = self._add([np.fromiter(chain.from_iterable(x), np.int32) for x in found], [np.array([len(ids) for ids in x]) for x in found])
        self.known.update(zip(new, places.tolist()))

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each vocabulary the ids of each text."""
        out: list[list[list[np.ndarray]]] = [[[] for _ in texts] for _ in self.coders]

        def put(group: list[tuple[int, str]]) -> None:
            for found, rows in zip(self._encode([t for _, t in group]), out):
                for (i, _), ids in zip(group, found):
                    rows[i].append(ids)

        group, held = [], 0
        for i, text in enumerate(texts):
            for part in slices(text, self.size):
                group.append((i, part))
                held += len(part)
                if held >= self.size:
                    put(group)
                    group, held = [], 0
        if group:
            put(group)
        return [[x[0] if len(x) == 1 else np.concatenate(x) for x in rows] for rows in out]

    def _encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        if len(self.known) > self.limit:
            self._forget()
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        before = self.places
        counts = np.fromiter((len(w) - 1 for w in split), np.int64, len(split))
        words = list(chain.from_iterable(w[1:] for w in split))
        k = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        fresh = np.flatnonzero(k == 0)
        if len(fresh):
            unknown = [words[i] for i in fresh.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            k[fresh] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        np.add.at(self.hits, k[(k > 0) & (k < before)], 1)
        word_end = np.cumsum(counts)
        slow = np.zeros(len(split), bool)
        slow[np.searchsorted(word_end, np.flatnonzero(k < 0), "right")] = True
        return [self._ids(c, texts, [w[0] for w in split], k, word_end, slow) for c in range(len(self.coders))]

    def _ids(self, c: int, texts: list[str], heads: list[str], k: np.ndarray, word_end: np.ndarray, slow: np.ndarray) -> list[np.ndarray]:
        coder = self.coders[c]
        flat, lengths = self._ids_at(c, k)  # nothing where k is -1; those texts are encoded whole
        cut = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], word_end))].tolist()
        whole = iter(coder.encode([texts[i] for i in np.flatnonzero(slow)]))
        first = iter(coder.encode([h for h, s in zip(heads, slow.tolist()) if h and not s]))
        out = []
        for head, is_slow, a, b in zip(heads, slow.tolist(), cut, cut[1:]):
            if is_slow:
                out.append(np.asarray(next(whole), np.int32))
            else:
                out.append(np.concatenate([np.asarray(next(first), np.int32), flat[a:b]]) if head else flat[a:b])
        return out


def _state() -> dict:
    """Caches and timers of this process. Functions reach the workers by value, so globals of this module last for one task only."""
    return vars(sys).setdefault("_termweave_pieces", {"caches": {}, "timers": []})


def _stop_timers() -> None:
    timers = _state()["timers"]
    while timers:
        timers.pop().cancel()


def cached(key: tuple, make: Callable[[], PieceCache]) -> PieceCache:
    """The cache of that key, which tasks of one process share; see ``forget_when_idle``."""
    _stop_timers()
    caches = _state()["caches"]
    if key not in caches:
        caches[key] = make()
    return caches[key]


def _forget_all() -> None:
    _state()["caches"].clear()
    give_back()


def forget_when_idle() -> None:
    """Python workers outlive their task and go on to other operators; give the caches' memory back if no task follows."""
    _stop_timers()
    timer = threading.Timer(IDLE_SECONDS, _forget_all)
    timer.daemon = True
    _state()["timers"].append(timer)
    timer.start()
