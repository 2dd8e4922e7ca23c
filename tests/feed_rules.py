"""The feed rules one row at a time, to check the Spark jobs against."""

from __future__ import annotations

from postlake import schema as S

WIDTHS = str.maketrans(S.WIDE_CHARS, S.NARROW_CHARS)


def strip_parens(value: str) -> str:
    open_at, kept = 0, []
    for ch in value:
        if ch == "(":
            open_at += 1
        elif ch == ")":
            open_at = open_at - 1 if open_at else 0
        elif not open_at:
            kept.append(ch)
    return "".join(kept)


def addresses(lines: list[list[str]], merge_before_strip: bool = False) -> list[tuple]:
    """Expected address rows of one feed, in file order."""

    def town_of(value: str) -> str:
        value = strip_parens(value)
        return "" if value == S.UNLISTED_TOWN else value

    merged: list[dict] = []
    for line in lines:
        if len(line) != S.FEED_WIDTH:
            continue
        pref, city, town = (line[i].translate(WIDTHS) for i in (6, 7, 8))
        row = {
            "zip": line[2],
            "city_id": line[0],
            "pref": pref,
            "city": city,
            "town": town if merge_before_strip else town_of(town),
            "flag": line[12] == "1",
        }
        last = merged[-1] if merged else None
        if (
            last
            and (last["zip"], last["city_id"]) == (row["zip"], row["city_id"])
            and not (last["flag"] or row["flag"])
        ):
            last["town"] += row["town"]
        else:
            merged.append(row)
    out: dict[tuple, tuple] = {}
    for m in merged:
        town = town_of(m["town"]) if merge_before_strip else m["town"]
        pref_id = S.PREFECTURES.index(m["pref"]) if m["pref"] in S.PREFECTURES else 0
        row = (m["zip"], pref_id, m["city_id"], m["pref"], m["city"], town)
        out.setdefault((m["zip"], pref_id, m["city"], town), row)
    return list(out.values())
