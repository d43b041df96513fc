"""Goals of spans in words: which arms a text names, and texts rewritten to name one.

The patterns are read the same way by Spark and by Python, so each question has a column expression and, for functions over whole
episodes, a plain form with the suffix ``_of``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that tell of arms, and the texts and phrases that are rewritten.
ARMS = ("left", "right")
BOTH = r"(?i)\b(?:both arms|dual arms|both objects|both grippers|grippers of both arms|corresponding arms)\b"
BOTH_PARTS = r"(?i)both arms|dual arms|corresponding arms|both objects|both grippers|grippers of both arms"
OTHER_MEANWHILE = r"(?i)\bleft arm\b.+\bwhile moving the right arm\b|\bright arm\b.+\bwhile moving the left arm\b"
RETURNING = r"(?i)\bwhile returning\b.+\b(?:neutral|default) pose\b"
RELEASE_THEN_ARM = r"(?i)\b(?:open|release)\b.*\b(left|right) arm\b"
ARM_THEN_RELEASE = r"(?i)\b(left|right) arm\b.*\b(?:open|release)\b"
BARE_GRIPPERS = {"Open the gripper.": "Open the gripper of the {} arm.", "Close the gripper.": "Close the gripper of the {} arm."}
GERUNDS = {"use ": "using ", "move ": "moving ", "place ": "placing ", "put ": "putting ", "drop ": "dropping "}
SIDE_PHRASES = ("left to right", "left position", "left side", "to the left of", "on the left of")
TABLE_HEIGHT = 0.74


def swapped(word: str) -> str:
    """A phrase with left and right exchanged."""
    return re.sub(r"left|right", lambda m: "right" if m[0] == "left" else "left", word)


# ---- Column expressions


def arm_context(text: Column) -> Column:
    """both, left or right, as the text names them; null without an arm."""
    left, right = text.rlike(r"(?i)\bleft arm\b"), text.rlike(r"(?i)\bright arm\b")
    return F.when(text.rlike(BOTH) | (left & right), "both").when(left, "left").when(right, "right")


def boundary_arm(source: Column) -> Column:
    """The arm in a boundary's name, null without one."""
    return F.nullif(F.regexp_extract(source, "_(left|right)_", 1), F.lit(""))


def uses_both(text: Column) -> Column:
    return text.rlike(BOTH_PARTS) | text.rlike(OTHER_MEANWHILE)


def returns_meanwhile(text: Column) -> Column:
    """Whether another arm returns to its pose while the text's action goes on."""
    return text.rlike(RETURNING)


def release_arm(text: Column) -> Column:
    """The arm that a text lets open or release; null without one."""
    first, second = F.regexp_extract(text, RELEASE_THEN_ARM, 1), F.regexp_extract(text, ARM_THEN_RELEASE, 1)
    return F.lower(F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))))


def with_arm(text: Column, arm: Column) -> Column:
    """The text with an arm named, where it names none."""
    named = F.lit(None).cast("string")
    for bare, whole in BARE_GRIPPERS.items():
        before, after = whole.split("{}")
        named = F.coalesce(named, F.when(text == bare, F.concat(F.lit(before), arm, F.lit(after))))
    target = F.regexp_extract(F.regexp_replace(text, r"\.+$", ""), "(?i)^move to (.+)$", 1)
    moved = F.when(target != "", F.concat(F.lit("Move the "), arm, F.lit(" arm to "), target, F.lit(".")))
    plain = F.concat(F.regexp_replace(text, r"\.$", ""), F.lit(" with the "), arm, F.lit(" arm"), F.when(text.endswith("."), ".").otherwise(""))
    return F.when(arm.isin(*ARMS) & arm_context(text).isNull(), F.coalesce(named, moved, plain)).otherwise(text)


def with_event_arm(text: Column, arm: Column) -> Column:
    """The text speaking of the arm of an event; texts of both arms, or of a first and a receiving one, stay."""
    keep = arm.isNull() | arm_context(text).eqNullSafe(F.lit("both")) | (text.rlike(r"\bfirst arm\b") & text.rlike(r"\breceiving arm\b"))
    said = F.concat(arm, F.lit(" arm"))
    out = F.regexp_replace(text, F.lit(r"\b(?:first|receiving|left|right) arm\b"), said)
    out = F.regexp_replace(out, F.lit(r"\bthe other arm\b"), F.concat(F.lit("the "), said))
    return F.when(keep, text).otherwise(with_arm(out, arm))


def exchanged(text: Column, pairs: tuple[str, ...]) -> Column:
    """Each phrase and its mirror image exchanged at once, in any case."""
    out = text
    marks = []
    for phrase in (p for word in pairs for p in (word, swapped(word))):
        marks.append((f"\u0001{len(marks)}\u0002", swapped(phrase)))
        out = F.regexp_replace(out, rf"(?i)\b{phrase}\b", marks[-1][0])
    for mark, phrase in marks:
        out = F.replace(out, F.lit(mark), F.lit(phrase))
    return out


def flip_arms(text: Column) -> Column:
    return exchanged(text, ("left arm",))


def flip_places(text: Column) -> Column:
    return exchanged(text, SIDE_PHRASES)


def flip_boundary(source: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(source, "(?<=_)left(?=_)", "\u0001"), "(?<=_)right(?=_)", "left")
    return F.replace(out, F.lit("\u0001"), F.lit("right"))


def flip_label(arm: Column) -> Column:
    return F.when(arm == "left", "right").when(arm == "right", "left").otherwise(arm)


def acting_arms(subtask_type: Column, text: Column) -> Column:
    """The arms that act in a span: both for dual types, else those named, else both."""
    named = F.filter(F.array(F.when(arm_context(text).isin("left", "both"), "left"), F.when(arm_context(text).isin("right", "both"), "right")), lambda a: a.isNotNull())
    every = F.array(*map(F.lit, ARMS))
    return F.when(F.coalesce(subtask_type, F.lit("")).startswith("dual_"), every).when(F.size(named) > 0, named).otherwise(every)


def state_arms(arms: Column, mapping: Column) -> Column:
    """The arms of the state that labels stand for: exchanged where the annotation says that labels are flipped."""
    return F.when(F.coalesce(F.contains(mapping, F.lit("flipped")), F.lit(False)), F.array_sort(F.transform(arms, flip_label))).otherwise(arms)


def expected_event(source: Column) -> Column:
    """The arm and kind of the gripper event that a boundary stands before; null for other boundaries."""
    pattern = "^(?:episode_end_after_)?before_gripper_(left|right)_(open|close)$"
    arm = F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))
    return F.when(arm.isNotNull(), F.struct(arm.alias("arm"), F.regexp_extract(source, pattern, 2).alias("kind")))


def lowered(text: Column) -> Column:
    """The first letter small."""
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def concurrent(text: Column) -> Column:
    """A sentence as a clause: a known verb at its head becomes a gerund, else its first letter is small."""
    bare = F.regexp_replace(F.trim(text), r"\.+$", "")
    out = lowered(bare)
    for verb, gerund in GERUNDS.items():
        out = F.when(F.lower(bare).startswith(verb), F.concat(F.lit(gerund), lowered(F.substr(bare, F.lit(len(verb) + 1))))).otherwise(out)
    return out


def joined_while(text: Column, other: Column) -> Column:
    """Two sentences as one: the first while the second; the first alone if the second is empty."""
    bare = F.regexp_replace(other, r"\.+$", "")
    return F.when(bare == "", text).otherwise(F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(" while "), lowered(bare), F.lit(".")))


def height_above_table(z: Column) -> Column:
    """Whole centimetres above the table, half to even."""
    return F.bround((z - TABLE_HEIGHT) * 100, 0).cast("int")


# ---- Plain forms


def arm_context_of(text: str) -> str | None:
    named = [a for a in ARMS if re.search(rf"(?i)\b{a} arm\b", text)]
    return "both" if len(named) == 2 or re.search(BOTH, text) else named[0] if named else None


def boundary_arm_of(source: str) -> str | None:
    found = re.search("_(left|right)_", source)
    return found[1] if found else None


def uses_both_of(text: str) -> bool:
    return bool(re.search(BOTH_PARTS, text) or re.search(OTHER_MEANWHILE, text))


def release_arm_of(text: str) -> str | None:
    found = re.search(RELEASE_THEN_ARM, text) or re.search(ARM_THEN_RELEASE, text)
    return found[1].lower() if found else None


def with_arm_of(text: str, arm: str | None) -> str:
    if arm not in ARMS or arm_context_of(text):
        return text
    if text in BARE_GRIPPERS:
        return BARE_GRIPPERS[text].format(arm)
    if found := re.match("(?i)move to (.+)$", text.rstrip(".")):
        return f"Move the {arm} arm to {found[1]}."
    return f"{text.removesuffix('.')} with the {arm} arm{'.' if text.endswith('.') else ''}"


def with_event_arm_of(text: str, arm: str | None) -> str:
    if arm is None or arm_context_of(text) == "both" or (re.search(r"\bfirst arm\b", text) and re.search(r"\breceiving arm\b", text)):
        return text
    out = re.sub(r"\b(?:first|receiving|left|right) arm\b", f"{arm} arm", text)
    return with_arm_of(re.sub(r"\bthe other arm\b", f"the {arm} arm", out), arm)


def lowered_of(text: str) -> str:
    return text[:1].lower() + text[1:]


def joined_while_of(text: str, other: str) -> str:
    bare = other.rstrip(".")
    return f"{text.rstrip('.')} while {lowered_of(bare)}." if bare else text


def concurrent_of(text: str) -> str:
    bare = text.strip().rstrip(".")
    verb = next((v for v in GERUNDS if bare.lower().startswith(v)), None)
    return GERUNDS[verb] + lowered_of(bare[len(verb) :]) if verb else lowered_of(bare)


def other_arm_of(arm: str | None) -> str | None:
    return {"left": "right", "right": "left"}.get(arm)
