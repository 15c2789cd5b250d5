"""A deterministic tokenization automaton, compiled from BPE merges one gadget at a time, and its byte transitions.

Before any merge the automaton has one state and an arc for every byte. Merge ``u v -> w`` composes it
with a gadget. For ``u != v`` the gadget gives every state that has an arc ``u`` an arc ``w`` to where
``u v`` led, and takes the arc ``v`` from the state behind ``u``. For ``u == v`` (runs pair up from the
left) ``w`` is added to every state but that behind ``u``; the state behind ``w`` keeps one arc ``u`` for
an odd rest, and the state behind ``u`` loses ``u``. So the state after a path depends on its last label
alone, and the accepted paths are exactly the outputs of BPE.

A gadget changes a row (the arcs of one state) or a column (one label at every state) of the arc table.
50,000 rows of 50,000 arcs don't fit into a worker, so the table is kept in copy-on-write form, in arrays: the row
and the column that each gadget copied, when it did, and the arcs that it cut. Arcs are read for many (state, label)
at once.

To read bytes the arcs are spelled out: a table ``(node, byte) -> node`` over the spellings of all labels, with
failure links as in Aho and Corasick, and for each node the labels that end there, longest first. Every prefix of a
word has one accepted path, so exactly one of the labels that end at a place continues the path accepted at its
start: a word is encoded in one pass over its bytes, without search or backtracking, and the path is read off from
its end. Nodes whose spelling is the word so far have that label compiled in. Words are encoded many at a time, a
byte of each at a step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: GPT-2's published pre-split pattern, with white space spelled out; fixed values.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Words are encoded beside others if they are up to WIDE bytes long, or if FEW are as long; words, and words times
#: bytes, that are encoded together; characters of a run of text.
WIDE, FEW, WORDS, CELLS, RUN = 64, 32, 1 << 14, 1 << 20, 1 << 20


def byte_letters() -> dict[str, int]:
    """The published one-letter names of the 256 bytes: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """A fixed map of int64 >= 0 to int32 in arrays (open addressing, at most a quarter full), read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]  # of several on one place the last stays
            self.values[at[free]] = values[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(default))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def stretches(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...``, ``count[0]`` of them, then those from ``first[1]`` on, and so forth."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Automaton:
    """Arcs are token ids; ``label[i]`` holds the bytes that arc ``i`` emits when decoding."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]], label: dict[int, bytes]):
        self.label = label
        n = 1 + max([*byte_ids, *(w for _, _, w in merges)], default=0)
        self.width = np.int64(n)
        self.born, self.row_of, self.col_of = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.doubled = np.zeros(n, bool)
        self.born[byte_ids] = 0
        born = dict.fromkeys(byte_ids, 0)
        for time, (u, v, w) in enumerate(merges, 1):
            if u not in born or v not in born or w in born:
                raise ValueError(f"merge {time} doesn't build on earlier ones")
            born[w] = time
        u, v, w = (np.array(x, np.int64) for x in (zip(*merges, strict=True) if merges else ([], [], [])))
        if len(np.unique(u * n + v)) < len(u):
            raise ValueError("a pair is merged twice")
        time = np.arange(1, len(w) + 1, dtype=np.int32)
        self.born[w], self.row_of[w], self.col_of[w], self.doubled[w] = time, v, u, u == v
        self.cut = Lookup(u * n + v, time)
        # A gadget for u v adds no arc if no path reads u, v by then.
        self.used = np.zeros(n, bool)
        self.used[byte_ids] = True
        self.used[w] = self.arcs(u, v, time)
        self._spell()

    def arcs(self, x: np.ndarray, y: np.ndarray, time: np.ndarray | None = None) -> np.ndarray:
        """Do the states behind ``x`` have the arcs ``y`` (once the gadgets before ``time`` are in)?"""
        out = np.zeros(len(x), bool)
        x, y, at = x.astype(np.int64), y.astype(np.int64), np.arange(len(x))
        time = np.full(len(x), np.iinfo(np.int32).max, np.int32) if time is None else time.astype(np.int32)
        while len(at):
            stays = self.cut.get(x * self.width + y, np.iinfo(np.int32).max) >= time
            x, y, time, at = x[stays], y[stays], time[stays], at[stays]
            bx, by = self.born[x], self.born[y]
            dx, dy = self.doubled[x], self.doubled[y]
            row, col = self.row_of[x], self.col_of[y]
            newer = bx >= by
            # Two bytes; the run u u u u, which is w w; one u that may be left behind w = u u.
            yes = (bx == 0) & (by == 0) | (x == y) & dx | newer & dx & (y == row)
            out[at[yes]] = True
            go = ~yes & (newer | ~dy | (x != col))  # u before u u would have paired first
            x, y, time, at = np.where(newer, row, x)[go], np.where(newer, y, col)[go], np.where(newer, bx, by)[go], at[go]
        return out

    def arc(self, x: int, y: int) -> bool:
        return bool(self.arcs(np.array([x]), np.array([y]))[0])

    def _spell(self) -> None:
        """Nodes are spellings of prefixes of labels, 0 the empty one, numbered by length."""
        tokens = np.flatnonzero(self.used & (self.born >= 0))
        size = np.zeros(len(self.born), np.int32)
        size[tokens] = [len(self.label[int(t)]) for t in tokens]
        node = np.zeros(len(self.born), np.int64)
        parents, by_byte, depth, ends = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int32)], [np.full(1, -1, np.int32)]
        total, longer, at = 1, tokens, 0
        while len(longer):
            step = node[longer] << 8 | np.array([self.label[int(t)][at] for t in longer], np.int64)
            new, which = np.unique(step, return_inverse=True)
            node[longer] = total + which
            at += 1
            done = size[longer] == at
            end = np.full(len(new), -1, np.int32)
            end[which[done]] = longer[done]
            parents.append(new >> 8), by_byte.append(new & 255), depth.append(np.full(len(new), at, np.int32)), ends.append(end)
            total, longer = total + len(new), longer[~done]
        parent, byte, depth, end = (np.concatenate(x) for x in (parents, by_byte, depth, ends))
        self.size, self.depth = size, depth
        self.goto = Lookup(parent[1:] << 8 | byte[1:], np.arange(1, total, dtype=np.int32))
        self.fail, self.last, self.ends = np.zeros(total, np.int32), np.full(total, -1, np.int32), end.copy()
        self.shorter = np.full(len(self.born), -1, np.int32)  # the next shorter label that ends a label
        for d in range(2, int(depth.max()) + 1):
            own = np.flatnonzero(depth == d)
            self.fail[own] = self._step(self.fail[parent[own]], byte[own])
        for d in range(1, int(depth.max()) + 1):
            own = np.flatnonzero(depth == d)
            behind = self.ends[self.fail[own]]
            self.shorter[end[own[end[own] >= 0]]] = behind[end[own] >= 0]
            self.ends[own] = np.where(end[own] >= 0, end[own], behind)
        # The last label of the path that emits a node's own spelling: that of the word so far, at the word's start.
        place = np.zeros((int(depth.max()) + 1, total), np.int32)  # the node of each length of a node's spelling
        for d in range(1, int(depth.max()) + 1):
            own = np.flatnonzero(depth == d)
            place[:, own] = place[:, parent[own]]
            place[d, own] = own
            self.last[own] = self._continued(self.ends[own], np.full(len(own), d), lambda k, start, place=place, own=own: self.last[place[start, own[k]]])

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The longest spelling that ends with each node's and the byte."""
        out = self.goto.get(node.astype(np.int64) << 8 | byte, -1)
        left = np.flatnonzero(out < 0)
        while len(left):
            node = node if len(node) == len(left) else node[left]
            byte = byte if len(byte) == len(left) else byte[left]
            at_root = node == 0
            out[left[at_root]] = 0
            left, node, byte = left[~at_root], self.fail[node[~at_root]], byte[~at_root]
            found = self.goto.get(node.astype(np.int64) << 8 | byte, -1)
            out[left] = found
            keep = found < 0
            left, node, byte = left[keep], node[keep], byte[keep]
        return out

    def _continued(self, token: np.ndarray, at: np.ndarray, last) -> np.ndarray:
        """The one label, of ``token`` and the shorter ones that end it, that continues the path accepted at its start.
        ``last(k, start)`` gives the last labels of these paths for the words ``k``."""
        out, left = np.full(len(token), -1, np.int32), np.arange(len(token))
        while len(left):
            if (token < 0).any():
                raise ValueError("no path emits the word")
            start = at[left] - self.size[token]
            fits = start == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.arcs(last(left[inner], start[inner]), token[inner])
            out[left[fits]] = token[fits]
            left, token = left[~fits], self.shorter[token[~fits]]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids by word) of the accepted paths that emit the words, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self.encode_flat(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)

    def encode_flat(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the words that stand at ``begin`` in ``raw``."""
        order = np.argsort(-size, kind="stable")
        count, parts = np.zeros(len(size), np.int64), []
        # Words far longer than the others are encoded alone: a step with few words costs as much as one with many.
        limit = min(CELLS // FEW, max(WIDE, int(size[order[FEW - 1]]) if len(size) >= FEW else 0))
        long = int((size > limit).sum())
        for i in order[:long]:
            ids = self._long(raw[begin[i] : begin[i] + size[i]].tobytes())
            count[i] = len(ids)
            parts.append(ids)
        at = long
        while at < len(size):
            group = order[at : at + min(WORDS, CELLS // (int(size[order[at]]) + 1))]
            ids, count[group] = self._group(raw, begin[group], size[group])
            parts.append(ids)
            at += len(group)
        # From the order by size back to that of the words.
        ids, first = np.concatenate([*parts, np.empty(0, np.int32)]), np.zeros(len(size), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return ids[stretches(first, count)], count

    def _group(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in falling order of size, a byte of each at a time."""
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # words of more bytes than each step
        last = np.zeros((longest + 1, len(size)), np.int32)
        node = np.zeros(len(size), np.int32)
        for i in range(longest):
            k = active[i]
            node = self._step(node[:k], raw[begin[:k] + i].astype(np.int64))
            whole = self.depth[node] == i + 1
            last[i + 1, :k] = np.where(whole, self.last[node], -1)
            rest = np.flatnonzero(~whole)
            last[i + 1, rest] = self._continued(self.ends[node[rest]], np.full(len(rest), i + 1), lambda w, start, rest=rest: last[start, rest[w]])
        at, own, steps = size.copy(), np.flatnonzero(size), []
        while len(own):
            token = last[at[own], own]
            steps.append((own, token))
            at[own] -= self.size[token]
            own = own[at[own] > 0]
        count = np.bincount(np.concatenate([s[0] for s in steps]), minlength=len(size)) if steps else np.zeros(len(size), np.int64)
        ids, end = np.empty(int(count.sum()), np.int32), np.cumsum(count) - 1
        for back, (own, token) in enumerate(steps):
            ids[end[own] - back] = token
        return ids, count

    def _long(self, word: bytes) -> np.ndarray:
        """The same pass over one long word; what it reads of the tables is remembered for this word only."""
        goto: dict[int, int] = {}
        known: dict[tuple[int, int], bool] = {}
        last, node = np.zeros(len(word) + 1, np.int32), 0
        size, shorter = self.size, self.shorter
        for i, byte in enumerate(word, 1):
            key = node << 8 | byte
            to = goto.get(key)
            if to is None:
                to = goto[key] = int(self._step(np.array([node]), np.array([byte], np.int64))[0])
            node = to
            token = int(self.ends[node])
            while True:
                if token < 0:
                    raise ValueError("no path emits the word")
                start = i - int(size[token])
                if not start:
                    break
                pair = int(last[start]), token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = self.arc(*pair)
                if fits:
                    break
                token = int(shorter[token])
            last[i] = token
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at -= int(size[last[at]])
        return np.array(path[::-1], np.int32)

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path that emits ``word``."""
        return self.encode_words([word])[0].tolist()


def load(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a byte-level BPE file of the tokenizers library, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    raw = {name: bytes(letters[c] for c in name) for name in vocab if all(c in letters for c in name)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    byte_ids = [vocab[c] for c in letters]
    label = {vocab[name]: b for name, b in raw.items()}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return Automaton(byte_ids, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], label), added


#: Two white-space characters of ASCII in a row, one of them a blank.
_PAIRS = [p for c in " \t\n\x0b\x0c\r" for p in {" " + c, c + " "}]


class Codec:
    """Whole texts to ids and back. Texts are read in runs of bounded size, and nothing is remembered beyond a run,
    so memory doesn't grow with the texts read. Each distinct part of a run is encoded once."""

    def __init__(self, path: str):
        self.automaton, self.added = load(path)
        self.labels = self.automaton.label | {i: s.encode() for s, i in self.added.items()}
        n = 1 + max(self.labels)
        self.names = pa.array([str(i) for i in range(n)], pa.string())
        self.emits = pa.array([self.labels.get(i, b"") for i in range(n)], pa.binary())
        self.pieces = regex.compile(PIECES)
        self.unusual = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.safe = regex.compile(rf"(?<=[^{SPACES}]) (?=[^{SPACES}])")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _single(self, text: str) -> bool:
        """Does each blank stand between characters that are no white space?"""
        return not (any(pair in text for pair in _PAIRS) or not text.isascii() and self.unusual.search(text))

    def _plain(self, text: str) -> bool:
        return self._single(text) and (self.special is None or not any(s in text for s in self.added))

    def _cut(self, text: str) -> list[str]:
        """Cut at single blanks between other characters: a piece begins at each, wherever it stands."""
        return text.split(" ") if self._single(text) else self.safe.split(text)

    def _parts(self, text: str | None) -> list[str]:
        """The parts that no piece crosses. The first of a segment is marked by a line feed, which no part behind a
        blank begins with; an added token by two."""
        if not text:
            return []
        if self.special is None or not any(s in text for s in self.added):
            parts = self._cut(text)
            parts[0] = "\n" + parts[0]
            return parts
        out = []
        for k, segment in enumerate(self.special.split(text)):
            if k % 2:
                out.append("\n\n" + segment)
            elif segment:
                parts = self._cut(segment)
                parts[0] = "\n" + parts[0]
                out += parts
        return out

    def runs(self, texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(numbers of texts, where each one's ids begin and the last ones end, ids) of runs of up to RUN characters. A
        longer text is several runs."""
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if size + len(text) > RUN and held:
                yield self._run(held)
                held, size = [], 0
            if len(text) > RUN:
                parts, begin = self._parts(text), 0
                while begin < len(parts):
                    end, room = begin, RUN
                    while end < len(parts) and room > 0:
                        room -= len(parts[end]) + 1
                        end += 1
                    yield [k], *self._encoded(pa.array(parts[begin:end], pa.large_string()), np.array([0, end - begin]))
                    begin = end
            else:
                held.append((k, text))
                size += len(text)
        if held:
            yield self._run(held)

    def _run(self, held: list[tuple[int, str]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        plain, numbers, other, rest = [], [], [], []
        for k, text in held:
            if self._plain(text):
                plain.append("\n" + text)
                numbers.append(k)
            else:
                rest.append(k)
                other.append(self._parts(text))
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        more = pa.array([p for parts in other for p in parts], pa.large_string())
        ends = np.concatenate([ends, ends[-1] + np.cumsum([len(parts) for parts in other], dtype=np.int64)])
        return numbers + rest, *self._encoded(pa.concat_arrays([cut.flatten(), more]), ends)

    def _encoded(self, parts: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the parts from each of ``bounds`` on begin, and the ids of all parts."""
        coded = parts.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        # Words behind a blank are pieces of their own, the commonest; the others are matched, and their pieces numbered.
        word = pc.utf8_is_alpha(distinct).to_numpy(zero_copy_only=False)
        piece: dict[str, int] = {}
        flat, sizes = [], np.ones(len(word), np.int64)
        n_words = int(word.sum())
        for i, part in zip(np.flatnonzero(~word).tolist(), distinct.filter(pa.array(~word)).to_pylist(), strict=True):
            if part[:2] == "\n\n" and part[2:] in self.added:  # a text that begins with a line feed is marked by one more
                flat.append(~self.added[part[2:]])
            else:
                found = self.pieces.findall(part[1:] if part[:1] == "\n" else " " + part)
                sizes[i] = len(found)
                flat += [piece.setdefault(p, len(piece)) for p in found]
        words = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), distinct.filter(pa.array(word)), pa.scalar(" ", pa.large_string()))
        words = pa.concat_arrays([words, pa.array(list(piece), pa.large_string())])
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ids, count = self.automaton.encode_flat(raw, offsets[:-1], np.diff(offsets))
        # Added tokens stand behind the ids of words and pieces.
        begin = np.cumsum(count) - count
        number = np.array(flat, np.int64)
        extra, where = np.unique(~number[number < 0], return_inverse=True)
        number[number >= 0] += n_words
        number[number < 0] = len(words) + where
        begin, count = np.concatenate([begin, len(ids) + np.arange(len(extra))]), np.concatenate([count, np.ones(len(extra), np.int64)])
        ids = np.concatenate([ids, extra.astype(np.int32)])
        each = np.empty(int(sizes.sum()), np.int64)
        is_word = np.repeat(word, sizes)
        each[is_word], each[~is_word] = np.arange(n_words), number
        # From pieces to distinct parts, and from these to all parts.
        ids = ids[stretches(begin[each], count[each])]
        ends = np.concatenate([[0], np.cumsum(count[each])])[np.concatenate([[0], np.cumsum(sizes)])]
        begin, count = ends[:-1], np.diff(ends)
        n = count[codes]
        return np.concatenate([[0], np.cumsum(n)])[bounds], ids[stretches(begin[codes], n)]

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for numbers, bounds, ids in self.runs(texts):
            for k, a, b in zip(numbers, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out[k].append(ids[a:b])
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.empty(0, np.int32)]) for x in out]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def counts(self, texts) -> np.ndarray:
        """The number of ids of each text, without keeping them."""
        out = np.zeros(len(texts), np.int64)
        for numbers, bounds, _ in self.runs(texts):
            np.add.at(out, numbers, np.diff(bounds))
        return out

    def written(self, texts) -> Iterator[tuple[int, int, str, bytes]]:
        """(text number, number of ids, ids as text, emitted bytes) by run, in order."""
        for numbers, bounds, ids in self.runs(texts):
            at, bounds = pa.array(ids), bounds.astype(np.int32)  # a run has far fewer than 2^31 ids
            strings, emitted = (pc.binary_join(pa.ListArray.from_arrays(bounds, x.take(at)), pa.scalar(by, x.type)) for x, by in ((self.names, ","), (self.emits, b"")))
            for k, n, string, label in zip(numbers, np.diff(bounds).tolist(), strings, emitted, strict=True):
                yield k, n, string.as_py(), label.as_py()

    def decode(self, ids) -> str:
        """Emit the label of each arc; bytes that are no UTF-8 become U+FFFD, unknown ids emit nothing."""
        return b"".join([self.labels.get(i, b"") for i in ids]).decode("utf-8", "replace")
