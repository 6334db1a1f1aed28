"""Units of flat pages against a plain loop over their lines."""

import random
import re

from tests.test_plans import plan_of
from warraq.bindings import MARKS, UNIFIED
from warraq.operators import segment
from warraq.operators.rules import NUMBER_HEAD, reconciled

BARE, FOLD = re.compile(f"[{MARKS}]"), str.maketrans(*UNIFIED)
OPENS = re.compile(segment.OPENER)
LATIN = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")


def norm(text):
    return re.sub(r"\s+", " ", BARE.sub("", text).translate(FOLD)).strip(" ")


def level(n):
    if len(n.split(" ")) > 25 or n.startswith("بسم الله الرحمن الرحيم"):
        return None
    return next((k for k, p in ((1, r"(كتاب|كتب)\s"), (2, r"ابواب\s"), (3, r"باب(\s|$)"), (4, r"(فصل|مساله)(\s|$)")) if re.match(p, n)), None)


def plain(page):
    marks, at = [], 0
    for line in page.split("\n"):
        head = re.match(NUMBER_HEAD, line, re.ASCII)
        number = int(head.group(1).translate(LATIN)) if head else 0
        marks.append([at, line, level(norm(line)), number, bool(OPENS.search(norm(line)))])
        at += len(line) + 1
    numbered = [m for m in marks if m[3]]
    stay = {id(numbered[i]) for i in reconciled([m[3] for m in numbered])}
    for m in marks:
        m[3] = m[3] if id(m) in stay else 0
    marks = [m for m in marks if m[2] is not None or m[3] or m[4]]
    for m in marks:
        m[0] += re.search("[0-9٠-٩]", m[1]).start() if m[3] else 0
    out, heading = [], None
    for i, (start, line, kind, number, _) in enumerate(marks):
        heading = line.strip(" ") if kind is not None else heading
        end = marks[i + 1][0] if i + 1 < len(marks) else len(page)
        unit = page[start:end].strip(" ")
        if kind is None and len(norm(unit)) >= 20:
            out.append((start, end, number or None, heading, unit))
    return out


def made(r):
    """A line of some kind, with blanks, marks and letters of other forms."""
    body = "قال رسول الله إنما الأعمال بالنيات وإنما لكل امرئ ما نوى"
    number = r.choice([r.randint(1, 9), r.randint(1, 60), 1432])
    line = r.choice([
        f"{number} - {body}", f"({str(number).translate(str.maketrans('0123456789', '٠١٢٣٤٥٦٧٨٩'))}) - {body}", f"[{number}] . قصير", "0 - صفر",
        "كِتَابُ الإيمان", "  بابٌ", "بابه غير هذا الباب المعروف", "أبواب الصلاة", "فصلٌ في البيان", "مسألة أخرى", "كتاب " + "كلمة " * 30,
        f"حَدَّثَنَا عبد الله {body}", f"أَخْبَرَنَا مالك {body}", f"عن نافع {body}", f"قال  رسول الله {body}", f"عنه {body}", body, "بسم الله الرحمن الرحيم", "", " ", "latin line of text",
    ])
    return r.choice(["", "", " ", "\t", " ", "ً "]) + line + r.choice(["", " ", "\r"])


def test_flat_units_of_odd_pages(spark):
    r = random.Random(8)
    pages = ["\n".join(made(r) for _ in range(r.randint(1, 25))) for _ in range(300)] + ["\n".join(made(r) for _ in range(1500)), "", "\n\n", "باب", "1 - " + "ً" * 70 + "كلمة " * 9, "2 - " + " ً" * 70 + "قصير"]
    rows = spark.createDataFrame([*enumerate(pages), (9999, None)], "passage_id long, text_raw string")
    got = sorted(tuple(x) for x in segment.segment_units_flat(rows).collect())
    assert got == sorted((i, *u) for i, p in enumerate(pages) for u in plain(p))


def test_flat_units_need_no_shuffle(spark):
    page = "كتاب الإيمان\n1 - حدثنا عبد الله بن يوسف\n2 - حدثنا عبد الله بن يوسف\n3 - حدثنا عبد الله بن يوسف"
    units = segment.segment_units_flat(spark.createDataFrame([(1, page)], "passage_id long, text_raw string"))
    assert units.count() == 3 and "Exchange" not in plan_of(units)
