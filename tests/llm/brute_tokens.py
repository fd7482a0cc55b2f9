"""A plain version of the alignment of two tokenizers."""

from __future__ import annotations

import hashlib
from collections import Counter

from attestry.llm import chunks, queries


def tokens_of(text, a, b):
    """(id, bytes) of both tokenizers, or nothing."""
    if not text:
        return None
    shown = {c: n for n, c in chunks.byte_alphabet().items()}
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(shown[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else None


def ends(tokens):
    at, out = 0, []
    for _, x in tokens:
        at += len(x)
        out.append(at)
    return out


def brute(docs):
    """(id, (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)) of each (id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    counts, read = Counter(), []
    for i, text in docs:
        found = tokens_of(text, a, b)
        if found is None:
            read.append((i, None))
            continue
        left, right = found
        le, re_ = ends(left), ends(right)
        links, y = [], 0
        for (x, _), start, end in zip(left, [0, *le], le, strict=False):
            while re_[y] <= start:
                y += 1
            k = y
            while k < len(right) and ([0, *re_][k]) < end:
                links.append((x, right[k][0]))
                k += 1
        counts.update(links)
        groups, p, q = [], 0, 0
        for cut in sorted(set(le) & set(re_)):
            m, n = le.index(cut, p) + 1, re_.index(cut, q) + 1
            groups.append(",".join(str(x) for x, _ in left[p:m]) + "|" + ",".join(str(x) for x, _ in right[q:n]))
            p, q = m, n
        read.append((i, (len(left), len(right), groups, links)))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, found in read:
        if found is None:
            out.append((i, (0, 0, 0, 0, 0, 0, "")))
            continue
        n_a, n_b, groups, links = found
        out.append((i, (n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())))
    return out
