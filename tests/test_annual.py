"""Annual filings against a plain reader that goes from line to line."""

import random
import re

from quillgraph.functions import annual as A
from quillgraph.functions.text import BANDS

BAND = re.compile("|".join(map(re.escape, sorted(BANDS, key=len, reverse=True))))
TAIL = re.compile(rf"({'|'.join(map(re.escape, A.TYPES))})\s+(\d\d?/\d\d?/\d{{4}})\s+(?:(?:Yes|No)\s+)?({BAND.pattern})\s*$", re.I)


def plain(text):
    out, part, account, row = [], None, None, None
    for number, page in enumerate(text.split("\f"), 1):
        for i, (name, title) in enumerate(A.PARTS.items(), 1):
            if any(re.match(rf"\s*Part {i}: .*{title}", x) for x in page.splitlines()):
                if name != part:
                    part, account, row = name, None, None
                break
        for line in page.splitlines() if part else ():
            if not line.strip() or any(re.search(p, line) for p in A.NOT_CONTENT):
                continue
            if m := re.match(r"\s*INVESTMENT ACCOUNT #(\d+)\s*$", line):
                account, row = int(m[1]), None
            elif m := re.match(r"\s{0,15}(\d+)(?:\.\s*|\s{2,})(.*)$", line):
                row = {"part": part, "page": number, "row_index": int(m[1]), "account_group": account if part in A.GROUPED else None, "raw": [line.rstrip()], "rest": [m[2]]}
                out.append(row)
            elif row:
                row["raw"].append(line.rstrip())
                row["rest"].append(line.strip())
    return [read(r) for r in out]


def read(r):
    rest, part, found = " ".join(r["rest"]), r["part"], {}
    bands = list(BAND.finditer(rest))
    if part in A.ASSETS:
        reason = None if bands else A.NO_BAND
        if bands:
            lead = rest[: bands[0].start()]
            mark = re.search(r"\s{2,}(N/A|Yes|No)\s*$", lead)
            found = {"description": (lead[: mark.start()] if mark else lead).strip(), "eif": mark and mark[1], "value_band": bands[0][0]}
            if len(bands) > 1:
                found |= {"income_type": rest[bands[0].end() : bands[1].start()].strip() or None, "income_band": bands[1][0]}
    elif part == "part_7_transactions":
        m = TAIL.search(rest)
        reason = None if m else A.NO_TAIL
        if m:
            kind = {"p": "purchase", "o": "exchange" if m[1].lower() == "oxchange" else "purchase", "s": "sale", "e": "exchange"}[m[1][0].lower()]
            found = {"description": rest[: m.start()].strip(), "transaction_type": kind, "transaction_raw": m[1], "trade_date": m[2], "amount_band": m[3]}
    elif part == "part_8_liabilities":
        reason = None if bands else A.NO_BAND
        if bands:
            found = {"amount_band": bands[0][0], "lead": rest[: bands[0].start()].strip(), "tail": rest[bands[0].end() :].strip()}
    elif part == "part_1_positions":
        reason = None if rest.strip() else A.STUB
        found = {"lead": rest.strip() or None}
    else:
        reason = A.NARRATIVE
    return (part, r["page"], r["account_group"], r["row_index"], "\n".join(r["raw"]), "low" if reason else "high", reason, *(found.get(f) for f in A.FOUND))


def filing(rng, pages):
    """Pages with headings or none, accounts, wrapped rows, rows that go on over a page, furniture and noise."""
    bands, titles = list(BANDS), list(A.PARTS.values())
    word = lambda: rng.choice(["Acme", "Fund", "LLC", "note", "N/A", "Sale", "Trust (NY)", "of", "1.5%", "Yes"])
    words = lambda n: " ".join(word() for _ in range(n))
    out, part, number = [], rng.randrange(9), 0
    for _ in range(pages):
        lines = ["OGE Form 278e (2024)", "Filer's Name    Doe, Ann", f"Page {rng.randrange(9)} of 9"] if rng.random() < 0.5 else []
        if rng.random() < 0.4:
            part = rng.randrange(9)
        if rng.random() < 0.7:
            lines.append(f"  Part {part + 1}: Filer's {titles[part]} and more")
        for _ in range(rng.randrange(9)):
            if rng.random() < 0.15:
                lines.append(f"   INVESTMENT ACCOUNT #{rng.randrange(900)}  ")
            number += 1
            lead = " " * rng.randrange(4) + rng.choice([f"{number}. ", f"{number}   ", f"{number}."]) + words(rng.randrange(4))
            kind = rng.choice([*A.TYPES, "gift"])
            tail = {7: f"  {kind}  1/2/2024 {rng.choice(['', 'Yes '])}{rng.choice(bands)}", 8: f"  {rng.choice(bands)}  2019  3% on demand"}.get(
                part + 1, f"   {rng.choice(['N/A', 'Yes', ''])}   {rng.choice(bands)} Dividends {rng.choice(bands) if rng.random() < 0.5 else ''}")
            if rng.random() < 0.3:
                tail = "  $9 - $10"
            lines += [lead, "", "      " + tail.strip() + "  "] if rng.random() < 0.3 else [lead + tail]
            if rng.random() < 0.2:
                lines.append("   # Description  Value")
        out.append("\n".join(lines))
    return "\f".join(out)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_rows_are_those_of_the_plain_reader(spark):
    rng = random.Random(6)
    docs = [(i, filing(rng, rng.randrange(1, 12))) for i in range(60)] + [(100, None), (101, ""), (102, "1.  no part\n"), (103, "Part 7: Transactions\r\n 1   A\x85B Purchase 1/1/2020 $0 - $200")]
    got = rows(A.annual(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == sorted(str((i, *r)) for i, t in docs if t for r in plain(t)) and len(got) > 500


def test_a_long_filing(spark):
    """Nine hundred pages of one filing, read with its rows in several tasks' memory bounds."""
    text = filing(random.Random(9), 900)
    got = rows(A.annual(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got == sorted(str((1, *r)) for r in plain(text)) and len(got) > 3000
