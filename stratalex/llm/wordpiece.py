"""Token counts by a linear longest-match automaton.

Words are runs of other than white space; each gets a space before it, as the
vocabulary's word-initial pieces have. Greedy longest match cuts a word, from
left to right, into the longest pieces of the vocabulary. The automaton walks
the vocabulary's trie byte by byte; where no branch goes on, a failure link
leads to the place in the trie of what is left after the longest pieces known
so far, and a precomputed count says how many pieces were completed on that
way. So a word's length in pieces comes from one pass without any piece being
built, linear in its bytes. All distinct words of a slice walk in step.

A byte that no piece begins with counts as a piece of its own.

Defined cases: null, empty and white texts have no words and no tokens; rows
are counted each; an empty table gives an empty result; further columns are
carried (clashing ones are replaced).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalex.llm.textkit import WHITE, bounded, slices, small_batches, span_hashes, spans, table


def vocabulary(path=None):
    """Pieces, as bytes, of a byte-level tokenizers file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {x["content"] for x in told.get("added_tokens", [])}
    return sorted(bytes(byte[c] for c in t) for t in told["model"]["vocab"] if t not in special and all(c in byte for c in t))


class Automaton:
    def __init__(self, pieces):
        children, parent, via, ends = [{}], [0], [0], [False]
        for p in [*pieces, *(bytes([b]) for b in range(256))]:
            u = 0
            for c in p:
                if c not in children[u]:
                    children[u][c] = len(children)
                    children.append({})
                    parent.append(u)
                    via.append(c)
                    ends.append(False)
                u = children[u][c]
            ends[u] = bool(p)
        n = len(children)
        fail, pops = [0] * n, [0] * n
        order = [0]
        for u in order:
            order.extend(children[u].values())
        for v in order[1:]:
            if ends[v]:
                fail[v], pops[v] = 0, 1  # the whole string is a piece
                continue
            u, c = parent[v], via[v]
            z, k = fail[u], pops[u]
            while c not in children[z]:
                k += pops[z]
                z = fail[z]
            fail[v], pops[v] = children[z][c], k
        rest = [0] * n  # pieces of what a node stands for
        for v in order[1:]:
            rest[v] = pops[v] + rest[fail[v]] if fail[v] != v else pops[v]
        edges = sorted((u << 8 | c, v) for u in range(n) for c, v in children[u].items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([v for _, v in edges], np.int32)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        # a node's rest needs its failure's first: failures are shallower, and order is by depth
        self.rest = np.array(rest, np.int32)

    def lengths(self, data, starts, ends):
        """Pieces of each word data[start:end] with a space before it."""
        n = len(starts)
        count = np.zeros(n, np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, size = starts[order], (ends - starts)[order]
        state = np.full(n, self.step_one(0, 32), np.int32)
        got = np.zeros(n, np.int64)
        live = n
        for j in range(int(size[0]) if n else 0):
            while live and size[live - 1] <= j:
                live -= 1
            todo = np.arange(live)
            c = data[starts[:live] + j].astype(np.int64)
            while len(todo):
                key = (state[todo].astype(np.int64) << 8) | c[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                state[todo[hit]] = self.to[at[hit]]
                todo = todo[~hit]
                got[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        count[order] = got + self.rest[state]
        return count

    def step_one(self, u, c):
        return int(self.to[np.searchsorted(self.keys, u << 8 | c)])


def _count_batches(held, text):
    def run(batches):
        machine = held.value
        for batch, data, offs in slices(batches, text):
            starts, ends, first = spans(~WHITE[data], offs)
            h = span_hashes(data, starts, ends, fold=False)
            _, where, back = np.unique(h, return_index=True, return_inverse=True)
            n = machine.lengths(data, starts[where], ends[where])[back]
            total = np.concatenate([[0], np.cumsum(n)])[first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first)), pa.array(np.diff(total))], names=[*batch.schema.names, "n_words", "n_tokens"])

    return run


def count_tokens(docs, pieces=None, text="text"):
    """docs with n_words and n_tokens added."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_tokens")
    held = docs.sparkSession.sparkContext.broadcast(Automaton(pieces if pieces is not None else vocabulary()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(bounded(_count_batches(held, text)), f"{schema}, n_words bigint, n_tokens bigint")


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("n_words"), F.col("n_tokens"))


def brute(text, pieces):
    """(words, tokens) by building the pieces; for tests."""
    known, most = set(pieces), max(map(len, pieces))
    words = n = 0
    for w in (text or "").encode().split():
        words += 1
        s = b" " + w
        while s:
            k = next((k for k in range(min(most, len(s)), 0, -1) if s[:k] in known), 1)
            s, n = s[k:], n + 1
    return words, n
