"""Plain page reading for small fixtures: one page at a time, fragment by fragment."""

from __future__ import annotations

import re

NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)%?\Z")
SHARE = re.compile(r"(?:\d+|\d{1,3}(?:,\d{3})+)\s+\((?:100(?:\.0+)?|\d{1,2}(?:\.\d+)?)%\)\Z")
VERBS = "shows presents summarises summarizes lists provides describes reports compares displays demonstrates outlines illustrates"
REFERENCE = re.compile(r"\s*TABLE\s+\d+\s+(?:" + "|".join(VERBS.split()) + r")\b", re.I)
HEADING = re.compile(r"\s*(?:(?:\d+(?:\.\d+)+\.?|\d+\.)\s+|(?:Results|Discussion|Conclusion|Methods|Introduction)\b)", re.I)


def right(f):
    return f["x"] + f["width"]


def number(f):
    return bool(NUMBER.match(f["text"].strip()) or SHARE.match(f["text"].strip()))


def words(f):
    return len(f["text"].strip().split())


def rows_of(items):
    rows = []
    for f in sorted(items, key=lambda f: (f["y"], f["x"], f["frag_id"])):
        if rows and abs(rows[-1][0]["y"] - f["y"]) < min(rows[-1][0]["height"], f["height"]) * 0.45:
            rows[-1].append(f)
        else:
            rows.append([f])
    return rows


def lines_of(items, column):
    out = []
    for row in rows_of(items):
        text, before = "", None
        row = sorted(row, key=lambda f: (f["x"], f["y"], f["frag_id"]))
        for f in row:
            wide = before is not None and f["x"] - right(before) > max(1, f["height"] * 0.12)
            text += (" " if wide and not re.search(r"\s\Z", text) and not re.match(r"\s", f["text"]) else "") + f["text"]
            before = f
        out.append((text.strip(), column, tuple(f["frag_id"] for f in row), min(f["x"] for f in row), min(f["y"] for f in row)))
    return out


def span(row):
    return max(map(right, row)) - min(f["x"] for f in row)


def bands_of(items, width):
    rows, bands = rows_of(items), []
    near = lambda x, xs, : any(abs(x - c) < width * 0.03 for c in xs)
    markers = [f for f in items if re.match(r"TABLE\s+\d+\b", f["text"].strip(), re.I) and not REFERENCE.match(f["text"])]
    for marker in sorted(markers, key=lambda f: (f["y"], f["frag_id"])):
        own = next(r for r in rows if any(f is marker for f in r))
        if marker["x"] > min(f["x"] for f in own) + 2 or REFERENCE.match(lines_of(own, "")[0][0]):
            continue
        if any(marker["y"] <= end for _, end in bands):
            continue
        below = [r for r in rows if r[0]["y"] > marker["y"]]
        if marker["x"] > width * 0.2:
            if marker["x"] > width * 0.4:
                continue
            heads = [r for r in below if r[0]["y"] - marker["y"] < 45 and len(r) >= 5 and span(r) > width * 0.5
                     and all(f["width"] < width * 0.2 and re.search("[A-Za-z]", f["text"]) for f in r)]
            after = [r for r in rows if heads and 0 < r[0]["y"] - heads[0][0]["y"] < 35]
            if not after:
                continue
            head = [f["x"] for f in heads[0]]
            fits = lambda r, head=head: (lambda v: len(v) >= len(head) and all(near(x, v) for x in head))([f["x"] for f in r if number(f)])
            if not fits(after[0]) or span(after[0]) <= width * 0.5:
                continue
            last = after[0]
            for r in rows:
                if r[0]["y"] > last[0]["y"]:
                    if r[0]["y"] - last[0]["y"] > 35 or not fits(r):
                        break
                    last = r
            bands.append((marker["y"] - 1, max(f["y"] + f["height"] for f in last) + 2))
            continue
        data = [r for r in below if len(r) >= 3 and sum(map(number, r)) >= 2 and span(r) > width * 0.45]
        if len(data) < 2 or data[0][0]["y"] - marker["y"] > 100:
            continue
        heads = [r for r in below if r[0]["y"] < data[0][0]["y"] and len(r) >= 3 and sum(not number(f) for f in r) >= 3
                 and all(f["width"] < width * 0.25 for f in r) and span(r) > width * 0.45]
        if not heads:
            continue
        columns, last, count = [f["x"] for f in heads[0] + data[0]], data[0], 1
        for r in rows:
            if r[0]["y"] <= last[0]["y"]:
                continue
            gap = r[0]["y"] - last[0]["y"]
            joined = lambda i, least, share, r=r: i > 0 and abs(r[i]["x"] - right(r[i - 1])) <= max(least, r[i]["height"] * share)
            short = sum(f["width"] < width * 0.25 for f in r)
            if gap > 45:
                break
            if (len(r) >= 2 and short >= 2 and span(r) > width * 0.25 and any(number(f) and near(f["x"], columns) for f in r)
                    and all(near(f["x"], columns) or joined(i, 2, 0.3) for i, f in enumerate(r))):
                last, count = r, count + 1
            elif (gap <= 25 and short == len(r) <= 4 and span(r) < width * 0.25 and near(r[0]["x"], columns)
                    and all(i == 0 or near(f["x"], columns) or joined(i, 6, 0.6) for i, f in enumerate(r))
                    and not HEADING.match(" ".join(f["text"] for f in r))):
                last = r
            else:
                break
        if count >= 2:
            bands.append((marker["y"] - 1, last[0]["y"] + last[0]["height"] + 2))
    return bands


def gutter_of(items, width, prefer):
    rows = rows_of(items)

    def veto(cut):
        n = 0
        for row in rows:
            runs, before = [], None
            for f in sorted(row, key=lambda f: (f["x"], f["y"], f["frag_id"])):
                if before is None or f["x"] - right(before) > max(2, min(f["height"], before["height"]) * 0.3):
                    runs.append([])
                runs[-1].append(f)
                before = f
            n += any(r[0]["x"] < cut < right(r[-1]) and right(r[-1]) - r[0]["x"] > width * 0.4 and sum(map(words, r)) >= 6 for r in runs)
        return n

    def search(start, end, require, score):
        best, at = None, start
        while at <= end:
            cut = width * at
            at += 0.01
            left, rest = [f for f in items if right(f) <= cut], [f for f in items if f["x"] >= cut]
            body = lambda fs, share=0.25: [f for f in fs if f["width"] > width * share and words(f) >= 6]
            if len(left) < 2 or len(rest) < 2 or score and (len(body(left)) < 4 or len(body(rest)) < 4):
                continue
            pick = lambda v, p: sorted(v)[int((len(v) - 1) * p + 0.5)]
            low = max(map(right, body(left))) if score else pick(list(map(right, left)), 0.9)
            high = min(f["x"] for f in body(rest)) if score else pick([f["x"] for f in rest], 0.1)
            ys = lambda fs: [f["y"] for f in fs]
            if high - low < width * 0.015 or min(max(ys(left)), max(ys(rest))) - max(min(ys(left)), min(ys(rest))) <= 0:
                continue
            if require and (len(body(left, 0.12)) < 4 or len(body(rest, 0.12)) < 4):
                continue
            crossing = [f for f in items if f["x"] < cut < right(f) and f["width"] < width * 0.65]
            wide = veto(cut)
            if wide >= 5 and wide > len(body(left)) + len(body(rest)):
                continue
            value = 2 * min(len(body(left)), len(body(rest))) - 3 * len(body(crossing)) if score else 2 * min(len(left), len(rest)) - 3 * len(crossing)
            if value > 0 and (best is None or value > best[0]):
                best = value, (low + high) / 2
        return best and best[1]

    return (prefer and search(0.35, 0.65, False, True)) or search(0.35, 0.65, False, False) or search(0.25, 0.75, True, False) or None


def stretch_lines(items, cut):
    if cut is None:
        return lines_of(items, "full")
    same = lambda a, b: abs(a["y"] - b["y"]) < min(a["height"], b["height"]) * 0.45
    over = [f for f in items if f["x"] < cut < right(f)]
    for f in over:  # grows while it is walked
        for g in items:
            gap = min(abs(g["x"] - right(f)), abs(f["x"] - right(g)))
            if not any(g is o for o in over) and same(f, g) and gap <= max(1, min(f["height"], g["height"]) * 0.12):
                over.append(g)
    rest = [f for f in items if not any(f is o for o in over)]
    out, sides = [], lambda fs: (lines_of([f for f in fs if f["x"] < cut], "left"), lines_of([f for f in fs if f["x"] >= cut], "right"))
    for separator in lines_of(over, "full"):
        anchor = min((f for f in over if f["frag_id"] in separator[2]), key=lambda f: (f["y"], f["x"], f["frag_id"]))
        peers = [f for f in rest if same(f, anchor)]
        above = [f for f in rest if f["y"] < separator[4] and not same(f, anchor)]
        out += sum(sides(above), [])
        rest = [f for f in rest if f["y"] >= separator[4] and not same(f, anchor)]
        left, far = sides(peers)
        out += sorted([*left, separator, *far], key=lambda line: line[3])
    return out + sum(sides(rest), [])


def read_page(items, width, mode):
    """Lines as (text, column, fragment ids) in reading order, the number of columns and of bands."""
    items = [{**f, "height": max(1.0, f["height"])} for f in items if f["text"] and f["text"].strip()]
    bands = bands_of(items, width) if mode == "auto" else []
    place = lambda f: max([(b, f["y"] > b[1]) for b in bands if b[0] <= f["y"]], default=((-1e300, 0), True))
    body = [f for f in items if place(f)[1]]
    cut = None if mode == "single" else gutter_of(body, width, mode == "auto")
    if mode == "two" and cut is None:
        cut = width / 2
    out = []
    for key in sorted({place(f) for f in items}):
        own = [f for f in items if place(f) == key]
        out += stretch_lines(own, cut) if key[1] else lines_of(own, "table")
    return [line[:3] for line in out], 1 if cut is None else 2, len(bands)
