"""Plain Python versions of the operators, for small tables."""

import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def jaccard_classes(rows, percent=75):
    """rows: (id, text).  Sorted (id, n_shingles, component, n_links)."""
    sets = [shingle_set(t) for _, t in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in lists[x]:
                shared[j] += 1
        for j, n in shared.items():
            if j != i and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        least[r] = min((k for k in (least.get(r), key) if k is not None), default=None)
    return sorted(((k, len(s), least[root(i)] if s else k, links[i]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def plain_shingles(text, n=5):
    words = "".join(c if c >= "\x80" or c.isalnum() else " " for c in (text or "").lower())
    words = [w for w in re.split(" +", words) if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def contaminated(docs, items, percent=75):
    best = {}
    for item, t in items:
        want = plain_shingles(t)
        for doc, text in docs:
            if item is None or doc is None or not want:
                continue
            n = len(want & plain_shingles(text))
            if n * 100 >= len(want) * percent:
                best[doc, item] = max(best.get((doc, item), (0, 0, 0)), (n / len(want), len(want), n))
    return sorted((d, i, n, m) for (d, i), (_, n, m) in best.items())


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def _units(text):
    """(start, end, normal words) of each unit."""
    out, last = [], None
    for m in WORD.finditer(text or ""):
        cut = last is None or "\n" in text[last.end():m.start()] or last[0][-1] in ".!?"
        word = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", m[0]).translate(LOWER)
        if cut:
            out.append([m.start(), m.end(), []])
        out[-1][1] = m.end()
        out[-1][2] += [word] if word else []
        last = m
    return out


def dedup_units(rows, min_words=20, unit_words=4):
    """(id, text, [(start, end, kept id)]) per row."""
    first, units = {}, {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        units[key] = _units(text)
        for u, (_, _, words) in enumerate(units[key]):
            if words:
                first.setdefault(tuple(words), (key, u))
    out = []
    for key, text in rows:
        spans, run = [], []
        for u, (start, end, words) in enumerate([*units.get(key, []), (0, 0, ["~"])]):
            place = first.get(tuple(words))
            if place and place != (key, u):
                run.append((start, end, len(words), place[0]))
                continue
            if not words and run:
                continue
            if sum(r[2] for r in run if r[2] >= unit_words) >= min_words:
                spans.append((run[0][0], run[-1][1], run[0][3]))
            run = []
        left = text
        for start, end, _ in reversed(spans):
            left = left[:start] + left[end:]
        out.append((key, left, spans))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i:i + 8])].append(i)
    repeated = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def judge_url(url, rules, listed):
    """host, path, rule, verdict, listed; rules: (host, path, verdict); listed: canonical (host, path)."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:n].translate(LOWER), rest[n:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    hit = host != "" and (host, path.rstrip("/")) in listed
    if fits:
        return host, path, max(fits)[1], max(fits)[2], hit
    return host, path, None, "block" if hit else "allow", hit


def mix_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, ceiling=2.0):
    """sizes: {source: words}.  Stop sources at the ceiling and deal their excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        deal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if deal[s] >= ceiling * sizes[s]]
        if not above:
            return stopped | deal
        for s in above:
            stopped[s] = ceiling * sizes[s]
            left -= stopped[s]


def rotate(turns, context=("system",)):
    """turns: (conv, turn, role, text).  {(conv, speaker): (rendering, trained spans)}"""
    talks = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, "unknown" if role is None else role, text or ""))
    guard = lambda t: t.replace("\\", "\\\\").replace("<|", "\\<|")
    out = {}
    for conv, rows in talks.items():
        for speaker in {r[2] for r in rows} - set(context):
            text, spans = "", []
            for _, _, role, said in sorted(rows):
                text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role in context else "<|user|>" + guard(role).replace("\n", " ").replace("\r", " ") + "\n"
                start = len(text)
                text += guard(said) + "<|end|>"
                spans += [(start, len(text))] if role == speaker else []
                text += "\n"
            out[conv, speaker] = (text, spans)
    return out


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def periodic_runs(text, exponent=4, shortest=6):
    """(runs by start and period, collapsed text), from the definition."""
    words = WORD.findall(text or "")
    runs = []
    for q in range(1, len(words) // exponent + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(shortest, exponent * q) and smallest_period(words[start:end + q]) == q:
                runs.append((start, length, q))
            start = end + 1
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def trie(sequences):
    """sequences: {conv_id: [(turn, words)]}.  Sorted rows of every prefix, subtree sums by walking all nodes."""
    import hashlib

    members = defaultdict(list)
    words = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            node = tuple(t for t, _ in turns[:d])
            members[node].append(conv)
            words[node] = turns[d - 1][1] if d else 0
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[node]]
        sums[node] = (sum(x for x, _ in below) or 1, (len(members[node]) - 1) * words[node] + sum(x for _, x in below))
    ends = defaultdict(list)
    for conv, turns in sequences.items():
        ends[tuple(t for t, _ in turns)].append(conv)
    rows = []
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), *sums[node], digest))
    return sorted(rows, key=str)


def turns_in_order(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: [((role, text), words)]}."""
    out = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, ((r[2] or "") + "\x01" + (r[3] or ""))[:64])):
        out[conv].append(((role or "", text or ""), len(WORD.findall(text or ""))))
    return dict(out)


def families(sequences):
    """Every conversation with the first turns of its family, as the query rebuilds them."""
    import zlib

    out = {}
    for conv, turns in sequences.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = sequences.get(conv - int(math.fmod(conv, 20)), [])[:h] + turns[h:]
    return out


def candidates(text):
    """(start, end) of the runs between blanks and edge signs that hold a digit or an @."""
    return [m.span() for m in re.finditer(r"""[^ \t\n\x0b\f\r"'(),;<>=:\[\]{}|]+""", text or "") if re.search("[0-9@]", m.group())]
