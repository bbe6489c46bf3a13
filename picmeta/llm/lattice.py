"""Segmentation lattices over a fixed public vocabulary of pieces.

`Vocabulary` holds the pieces in a double-array trie. `Lattice` finds, for a
batch of words at once, every piece at every position, and runs Viterbi,
the log-space forward recursion, or expected piece counts over all segmentations.
All steps are numpy operations over the whole batch; the number of steps is the
length of the longest word.

The public vocabulary ranks its pieces by merges and its scores are negative
ranks, not log probabilities. `zipf` turns rank r into the log probability
-ln(r + 2.7) - ln Z (Zipf-Mandelbrot), which is what the operators use as
existing unigram scores; "file" keeps the scores of the file.
"""

from __future__ import annotations

import numpy as np

MARK = "▁"  # stands for a space in pieces
MARK_BYTES = MARK.encode()
UNKNOWN_PENALTY = 10.0
OFFSET = 2.7
WINDOW = 512  # places that the trie's builder tries at once


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of the trie of sorted keys; value[s] is the number of the key that ends in state s, or -1."""
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    todo, first, wide = [(0, 0, len(keys), 0)], 258, 258  # so that no base is below 1
    for state, lo, hi, depth in todo:  # grows as it goes: breadth first
        if lo < hi and len(keys[lo]) == depth:
            value[state] = lo
            lo += 1
        spans: list[tuple[int, int, int]] = []
        at = lo
        while at < hi:
            c, start = keys[at][depth], at
            while at < hi and keys[at][depth] == c:
                at += 1
            spans.append((c + 1, start, at))
        if not spans:
            continue
        while check[first] >= 0:
            first += 1
        codes = np.array([c for c, _, _ in spans])
        b = max(1, (first if len(codes) == 1 else wide) - int(codes[0]))
        while True:
            if b + 2 * WINDOW > len(check):
                base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            fits = np.flatnonzero((check[b + np.arange(WINDOW)[:, None] + codes] < 0).all(axis=1))
            if len(fits):
                b += int(fits[0])
                break
            b += WINDOW
        if len(codes) > 1:  # states of one child fill what the others leave
            wide = b + int(codes[0])
        base[state] = b
        for c, start, end in spans:
            check[b + c] = state
            todo.append((b + c, start, end, depth + 1))
    return base, check, value


class Vocabulary:
    """pieces by id, their log scores, and the trie of the ordinary pieces."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, ordinary: np.ndarray, bytes_at: list[int]):
        """ordinary: ids of the pieces that the trie finds; bytes_at: the id of each byte's piece."""
        order = sorted(ordinary.tolist(), key=lambda i: pieces[i])
        self.base, self.check, value = double_array([pieces[i] for i in order])
        self.value = np.where(value >= 0, np.array([*order, -1], np.int32)[value], -1)
        self.pieces, self.scores, self.bytes_at = pieces, scores, np.array(bytes_at, np.int64)
        self.unknown = len(pieces)  # one more id, for a character that no piece covers
        self.unknown_score = float(scores[ordinary].min()) - UNKNOWN_PENALTY
        inner = [p for i in order if MARK_BYTES in (p := pieces[i])[1:] and p.replace(MARK_BYTES, b"")]
        if inner or any(b"\n" in pieces[i] or b" " in pieces[i] for i in order):
            raise ValueError("a piece of this vocabulary spans words; they can't be segmented apart")

    @classmethod
    def of(cls, plain: dict) -> Vocabulary:
        """The vocabulary whose vars were sent: plain arrays and lists, so that a broadcast needs no copy of this package on executors."""
        made = cls.__new__(cls)
        made.__dict__.update(plain)
        return made

    @classmethod
    def load(cls, path: str | None = None, scores: str = "zipf") -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
        n = sp.get_piece_size()
        ordinary = np.array([i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))])
        pieces = [sp.id_to_piece(i).encode() for i in range(n)]
        bytes_at = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        own = np.array([sp.get_score(i) for i in range(n)])
        if scores == "zipf":
            rank = np.empty(len(ordinary))
            rank[np.argsort(-own[ordinary], kind="stable")] = np.arange(len(ordinary))
            p = 1 / (rank + OFFSET)
            own[:] = np.log(p.min() / p.sum()) - UNKNOWN_PENALTY
            own[ordinary] = np.log(p / p.sum())
        return cls(pieces, own, ordinary, bytes_at)


class Lattice:
    """All arcs (piece occurrences) of a batch of words."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        lens = np.array([len(w) for w in words], np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        buf = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lens)
        begins = np.flatnonzero((buf & 0xC0) != 0x80)
        end = off[1:][word]
        pos, state = begins, np.zeros(len(begins), np.int32)
        found = []
        for depth in range(int(lens.max(initial=0))):
            alive = pos + depth < end[pos]
            pos, state = pos[alive], state[alive]
            nxt = vocab.base[state] + 1 + buf[pos + depth]
            ok = vocab.check[nxt] == state
            pos, state = pos[ok], nxt[ok]
            if not len(pos):
                break
            hit = vocab.value[state] >= 0
            if hit.any():
                found.append((pos[hit], pos[hit] + depth + 1, vocab.value[state[hit]]))
        char_end = np.empty(len(begins), np.int64)
        char_end[:-1], char_end[-1:] = begins[1:], len(buf)
        covered = np.zeros(len(buf) + 1, bool)
        ends_at = np.full(len(buf) + 1, -1, np.int64)
        ends_at[begins] = char_end
        for s, e, _ in found:
            covered[s[ends_at[s] == e]] = True
        bare = ~covered[begins]
        found.append((begins[bare], char_end[bare], np.full(bare.sum(), vocab.unknown)))
        start, stop, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
        w = word[start] if len(start) else start
        order = np.lexsort((stop + w, stop - off[w]))
        start, stop, w = start[order], stop[order], w[order]
        self.piece, self.start, self.stop, self.raw = piece[order].astype(np.int64), start + w, stop + w, (start, stop, buf)
        self.first, self.last = off[:-1] + np.arange(len(words)), off[1:] + np.arange(len(words))
        self.nodes = int(off[-1]) + len(words)
        depth = stop - off[w]
        self.steps = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]]) if len(depth) else np.array([0])

    def _pass(self, score: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
        """For each node, ufunc over the paths from its word's start. score: a row per arc."""
        at = np.full((self.nodes, score.shape[1]), -np.inf)
        at[self.first] = 0.0
        for a, b in zip(self.steps[:-1], self.steps[1:], strict=True):
            stop = self.stop[a:b]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(stop)) + 1])
            at[stop[heads]] = ufunc.reduceat(at[self.start[a:b]] + score[a:b], heads, axis=0)
        return at

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations: a row per word, a column per column of logp (by piece)."""
        return self._pass(logp[self.piece], np.logaddexp)[self.last]

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x columns of weight), words weighted by weight, segmentations by logp (one column)."""
        score = logp[self.piece]
        alpha = self._pass(score, np.logaddexp)
        beta = np.full_like(alpha, -np.inf)
        beta[self.last] = 0.0
        begin = self.start - self.first[np.searchsorted(self.first, self.start, side="right") - 1]
        order = np.lexsort((self.start, -begin))
        s, e, sc = self.start[order], self.stop[order], score[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(begin[order])) + 1, [len(order)]]) if len(order) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            heads = np.concatenate([[0], np.flatnonzero(np.diff(s[a:b])) + 1])
            beta[s[a:b][heads]] = np.logaddexp.reduceat(beta[e[a:b]] + sc[a:b], heads, axis=0)
        w = np.searchsorted(self.first, self.start, side="right") - 1
        post = np.exp(alpha[self.start, 0] + score[:, 0] + beta[self.stop, 0] - alpha[self.last[w], 0])
        return np.stack([np.bincount(self.piece, post * weight[w, k], len(logp)) for k in range(weight.shape[1])], axis=1)

    def viterbi(self, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of every word, end to end, and the offsets of the words. Unknown characters become bytes."""
        score = np.append(vocab.scores, vocab.unknown_score)[self.piece][:, None]
        best = self._pass(score, np.maximum)
        reach = best[self.start, 0] + score[:, 0] == best[self.stop, 0]
        back = np.full(self.nodes, -1, np.int64)
        arcs = np.flatnonzero(reach)[::-1]
        back[self.stop[arcs]] = arcs
        steps, node, own = [], self.last.copy(), np.arange(len(self.last))
        while True:
            open_ = node > self.first[own]
            node, own = node[open_], own[open_]
            if not len(node):
                break
            arc = back[node]
            steps.append((own, arc))
            node = self.start[arc]
        if not steps:
            return np.empty(0, np.int32), np.zeros(len(self.last) + 1, np.int64)
        own, arc = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
        order = np.lexsort((self.start[arc], own))
        own, arc = own[order], arc[order]
        start, stop, buf = self.raw
        unknown = self.piece[arc] == vocab.unknown
        n = np.where(unknown, stop[arc] - start[arc], 1)
        ids = np.repeat(self.piece[arc], n)
        if unknown.any():
            first = np.cumsum(n) - n
            at = np.repeat(start[arc] - first, n) + np.arange(len(ids))
            spread = np.repeat(unknown, n)
            ids[spread] = vocab.bytes_at[buf[at[spread]]]
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(np.repeat(own, n), minlength=len(self.last)))])
