"""Recall of op9 on whole tables: its components against an exact prefix-filtered join. ``python tests/llm/exact_links.py SF_DIR [K]``"""

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components(rows, k, threshold=80):
    """({id: (set size, least id reachable)}, links between different sets) of (id, text) rows."""
    sets = {i: shingles(t, k) for i, t in rows}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    distinct = sorted((s for s in classes if s), key=len)
    frequency = Counter(x for s in distinct for x in s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    index, links = defaultdict(list), 0
    for n, s in enumerate(distinct):
        for other in classes[s][1:]:
            join(classes[s][0], other)
        # a like set of this size or less shares one of the rarest elements
        prefix = sorted(s, key=lambda x: (frequency[x], x))[: len(s) - -(-threshold * len(s) // 100) + 1]
        met = {m for x in prefix for m in index[x] if 100 * len(distinct[m]) >= threshold * len(s)}
        for m in met:
            common = len(s & distinct[m])
            if 100 * common >= threshold * (len(s) + len(distinct[m]) - common):
                links += 1
                join(classes[s][0], classes[distinct[m]][0])
        for x in prefix:
            index[x].append(n)
    return {i: (len(s), find(i) if s else i) for i, s in sets.items()}, links


if __name__ == "__main__":
    from spanloom.llm import near_dedup
    from spanloom.session import local_session

    folder, k = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 2
    docs = local_session(4).read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want, links = components([(r.doc_id, r.text) for r in docs.collect()], k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, k).collect()}
    wrong = sum(got[i] != w for i, w in want.items())
    print(f"{len(want)} documents, {k} words: {links} links between different sets, {wrong} rows wrong")
