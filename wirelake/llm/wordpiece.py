"""Token counts by greedy longest match: a vocabulary trie with failure links and precomputed popped-token counts.

A word is read once, byte by byte. Where no edge leads on, the failure link of the state pops the tokens that greedy
matching would take and goes to the state of what is left, so a word takes time in proportion to its length and no
piece is ever built. Words repeat, so a task counts each different word once and remembers it.
"""

from __future__ import annotations

import json
from collections import Counter, deque

from pyspark.sql import DataFrame

from wirelake.llm.common import add_columns, field

#: Counted words remembered by a worker; forgotten all at once when full, which changes no result.
REMEMBERED = 400_000


def byte_vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level vocabulary file as bytes; a leading space marks the start of a word."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters |= {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    return [bytes(letters[c] for c in token) for token in vocab if all(c in letters for c in token)]


class Automaton:
    """Greedy longest-match counts over a vocabulary of byte strings.

    State 0 is the root. For a state v with text s: if s is a token, one token is popped and nothing is left; else
    greedy matching of s pops popped[v] tokens and leaves the text of state link[v] (-1: s can't be matched).
    """

    def __init__(self, tokens: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        final = set()
        for token in tokens:
            at = 0
            for byte in token:
                nxt = self.edges[at].get(byte)
                if nxt is None:
                    nxt = self.edges[at][byte] = len(self.edges)
                    self.edges.append({})
                at = nxt
            final.add(at)
        final.discard(0)
        self.link, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        self.final = final
        queue = deque([0])
        while queue:  # by depth: a state's link needs those of shorter texts
            v = queue.popleft()
            for byte, child in self.edges[v].items():
                queue.append(child)
                if child in final:
                    self.link[child], self.popped[child] = 0, 1
                    continue
                u, taken = self.link[v], self.popped[v]
                while u >= 0 and byte not in self.edges[u]:
                    taken += self.popped[u]
                    u = self.link[u]
                if u >= 0:
                    self.link[child], self.popped[child] = self.edges[u][byte], taken

    def count(self, word: bytes) -> int:
        """Tokens of greedy longest match over the whole word; -1 if some part of it matches no token."""
        edges, link, popped = self.edges, self.link, self.popped
        at = taken = 0
        for byte in word:
            while byte not in edges[at]:
                if link[at] < 0:
                    return -1
                taken += popped[at]
                at = link[at]
            at = edges[at][byte]
        while at:
            if link[at] < 0:
                return -1
            taken += popped[at]
            at = link[at]
        return taken


_MADE: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, n_tokens (greedy longest-match pieces of all words) and n_unknown (words with a part that no
    piece matches; each is one token).

    `vocabulary` is the path of a byte-level vocabulary, the same on every executor. Words are `[^\\x20\\x09-\\x0D]+`
    with a leading space. Null and empty texts have zero of each; columns of such names are replaced; repeated rows
    count each for itself. Texts are taken whole, however long; an empty table gives an empty one.
    """
    def make():
        if vocabulary not in _MADE:
            _MADE[vocabulary] = Automaton(byte_vocabulary(vocabulary)), {}
        automaton, known = _MADE[vocabulary]

        def one(text: str | None) -> tuple[int, int, int]:
            words = Counter((text or "").encode().split())
            if len(known) > REMEMBERED:
                known.clear()
            total = tokens = unknown = 0
            for word, times in words.items():
                n = known.get(word)
                if n is None:
                    n = known[word] = automaton.count(b" " + word)
                total += times
                unknown += times * (n < 0)
                tokens += times * abs(n)
            return total, tokens, unknown

        return lambda texts: list(zip(*map(one, texts)))

    return add_columns(docs, text_col, [field("n_words", "long"), field("n_tokens", "long"), field("n_unknown", "long")], make)
