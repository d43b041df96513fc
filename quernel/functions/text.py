"""String functions as column expressions: answer extraction, clean-up, task names, arm and action words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The failed-call text, the refusals, the characters that separate options, and the patterns of arms and actions.
FAILED = "Failed to obtain answer via API"
REFUSALS = (
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
)
SEPARATORS = ".()[],:;!*#{}"
BOTH_ARMS = r"\b(?:both arms|dual arms|both grippers|grippers of both arms|both objects)\b"
OPEN_WORDS = r"\bopen the gripper|open the grippers|release\b"
CLOSE_WORDS = r"\bclose the gripper|close the grippers|partially close\b"
MOVE_WORDS = r"\b(move|lift|place|return|retract|pull|scan|rotate|shake|press|operate|click|hit|pour|open the .*door|open the .*lid)\b"


def tokens(text: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """A value computed once and used several times in a column: functions of arrays are else computed for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def option_letter(answer: Column, options: Column) -> Column:
    """The one option letter that stands alone in an answer; Z for a refusal; null if none or several do.

    'A' is not believed in answers of more than three tokens, where it may be an article.
    """
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | F.contains(answer, F.lit(phrase))

    def picked(plain: Column) -> Column:
        found = lambda f: (
            F.when((F.size(f) == 1) & ~(F.array_contains(plain, "A") & (F.size(plain) > 3)), F.get(f, F.lit(0)))
            .when((F.size(f) == 0) & F.array_contains(plain, "Z"), F.lit("Z"))
        )
        return bound(F.array_intersect(F.array_distinct(plain), F.map_keys(options)), found)

    letter = bound(tokens(F.translate(answer, SEPARATORS, " " * len(SEPARATORS))), picked)
    return F.when(F.contains(answer, F.lit(FAILED)), F.lit(None).cast("string")).when(refused, F.lit("Z")).otherwise(letter)


def option_text(answer: Column, options: Column) -> Column:
    """The one option whose text the answer holds, in any case; null if none or several do."""
    held = F.map_filter(options, lambda k, v: F.contains(F.lower(answer), F.lower(v)))
    return F.when(F.size(held) == 1, F.element_at(F.map_keys(held), 1))


def infer_option(answer: Column, options: Column) -> Column:
    return F.coalesce(option_letter(answer, options), option_text(answer, options))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last mark (all, without one), trimmed."""
    return F.trim(F.substring_index(text, mark, -1))


def without_fences(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))


def last_block(text: Column, begin: str, end: str) -> Column:
    """The content of the last block between two marks, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){begin}(.*?){end}"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def printable(text: Column) -> Column:
    """No control characters but tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def file_name(text: Column, longest: int = 40, empty: str = "item") -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.left(F.when(name == "", F.lit(empty)).otherwise(name), F.lit(longest))


def task_slug(name: Column, mark: str = "-robot-") -> Column:
    """What stands before the mark, else before the first hyphen."""
    return F.when(F.contains(name, F.lit(mark)), F.substring_index(name, mark, 1)).otherwise(F.substring_index(name, "-", 1))


def arm_flags(text: Column) -> tuple[Column, Column]:
    """Whether a text names the left and the right arm; 'both arms' and the like name both."""
    low = F.lower(text)
    both = low.rlike(BOTH_ARMS)
    return low.rlike(r"\bleft arm\b") | both, low.rlike(r"\bright arm\b") | both


def action_kind(text: Column) -> Column:
    """open before close before move, by the first class whose words occur."""
    low = F.lower(text)
    return F.when(low.rlike(OPEN_WORDS), "open").when(low.rlike(CLOSE_WORDS), "close").when(low.rlike(MOVE_WORDS), "move").otherwise("unknown")


def swap_sides(text: Column) -> Column:
    """left and right exchanged everywhere at once."""
    out = F.regexp_replace(text, r"\bleft\b", "\u0001")
    return F.regexp_replace(F.regexp_replace(out, r"\bright\b", "left"), "\u0001", "right")


def goal_tokens(goals: Column) -> Column:
    """Tokens of small, blank-collapsed goals."""
    return tokens(F.lower(F.array_join(goals, " ")))


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of tokens.

    Each distinct token is written as one character, so that the built-in distance of strings counts tokens. The characters
    go on from '0' through all code points but the surrogates; more than 1.1 million distinct tokens fail to decode.
    """
    every = F.array_distinct(F.concat(a, b))
    point = lambda t: F.array_position(every, t) + 47
    shown = lambda n: F.decode(F.unhex(F.lpad(F.hex(n + F.when(n >= 0xD800, 0x800).otherwise(0)), 8, "0")), "UTF-32")
    sign = lambda t: shown(point(t))
    small = F.levenshtein(F.array_join(F.transform(a, sign), ""), F.array_join(F.transform(b, sign), ""))
    return small


def smoothed_precision(reference: Column, prediction: Column, n: int) -> Column:
    """Add-one smoothed, clipped n-gram precision of arrays of tokens."""
    runs = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda k: F.array_join(F.slice(t, k, n), "\u0001"))).otherwise(F.array().cast("array<string>"))
    said, wanted = runs(prediction), runs(reference)
    count = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    clipped = F.aggregate(F.array_distinct(said), F.lit(0), lambda acc, x: acc + F.least(count(said, x), count(wanted, x)))
    return (clipped + 1) / (F.size(said) + 1)


def bleu(reference: Column, prediction: Column, most: int = 4) -> Column:
    """Smoothed sentence BLEU of arrays of tokens; 0 if either is empty."""
    logs = sum((F.log(smoothed_precision(reference, prediction, n)) for n in range(2, most + 1)), F.log(smoothed_precision(reference, prediction, 1)))
    r, p = F.size(reference), F.size(prediction)
    brevity = F.when(p > r, F.lit(1.0)).otherwise(F.exp(1 - r / F.greatest(F.lit(1), p)))
    return F.when((r == 0) | (p == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs / most))


def option_map(values: Column) -> Column:
    """Options A, B, C ... for an array of values."""
    return F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda k: F.char(k + 65)), values)


def placeholders(text: Column, marks: tuple[str, ...]) -> Column:
    """The pieces of a text, marks kept, blank pieces dropped."""
    choice = "|".join(marks)
    return F.filter(F.transform(F.split(text, f"(?={choice})|(?<={'|'.join(marks)})"), lambda p: F.trim(p)), lambda p: p != "")


def json_or_null(text: Column, schema: str) -> Column:
    """Parsed JSON, null where the text is not JSON."""
    return F.from_json(text, schema)


def without_image_marks(text: Column) -> Column:
    """No reference tags, and no boxes with what is in them (to the end, where one is not closed)."""
    return F.regexp_replace(F.regexp_replace(text, "</?ref>", ""), "<box>.*?(?:</box>|$)", "")


#: Signs of code that a page would read as marks.
CODE_SIGNS = {"`": "\\`", "<": "&lt;", ">": "&gt;", " ": "&nbsp;", "*": "&ast;", "_": "&lowbar;", "-": "&#45;", ".": "&#46;", "!": "&#33;", "(": "&#40;", ")": "&#41;", "$": "&#36;"}


def as_html(text: Column) -> Column:
    """Markdown with fenced code as HTML: lines without empty ones, code signs as entities; odd fences open and even ones close."""
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    fenced = lambda line: F.contains(line, F.lit("```"))
    before = lambda k: F.size(F.filter(F.slice(lines, F.lit(1), k), fenced))

    def shown(line: Column, k: Column) -> Column:
        code = line
        for sign, entity in CODE_SIGNS.items():
            code = F.replace(code, F.lit(sign), F.lit(entity))
        inside = before(k) % 2 == 1
        fence = F.when(inside, F.lit("<br></code></pre>")).otherwise(F.concat(F.lit('<pre><code class="language-'), F.substring_index(line, "`", -1), F.lit('">')))
        return F.when(fenced(line), fence).when(k == 0, line).otherwise(F.concat(F.lit("<br>"), F.when(inside, code).otherwise(line)))

    return F.array_join(F.transform(lines, shown), "")


def same_output(lines: Column, wanted: Column) -> Column:
    """Whether lines of output are the wanted text, at their ends or each line stripped of blanks."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return (strip(F.array_join(lines, "\n")) == strip(wanted)) | (strip(F.array_join(F.transform(lines, strip), "\n")) == strip(wanted))


def interleaved(text: Column, images: Column) -> Column:
    """Text around image marks with the images in between, by position; empty pieces of text fall away."""
    pieces = F.split(text, r"!\[image\]\(.*?\)")
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    both = F.transform(pieces, lambda p, k: F.array(part("text", p), part("image", F.get(images, k))))
    return F.filter(F.flatten(both), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def window_scores(wanted: Column, said: Column, most: int) -> Column:
    """Scores of the first goals: BLEU, edits, edits a token, and whether they are the same goals."""
    clean = lambda goals: F.transform(F.slice(goals, 1, most), lambda g: F.array_join(tokens(F.lower(F.coalesce(g, F.lit("")))), " "))

    def scored(x: Column) -> Column:
        edits = token_distance(x["ta"], x["tb"])
        return bound(edits, lambda e: F.struct(bleu(x["ta"], x["tb"]).alias("bleu"), e.alias("edits"), (e / F.greatest(F.lit(1), F.size(x["ta"]))).alias("share"), (x["a"] == x["b"]).alias("exact")))

    cleaned = F.struct(clean(wanted).alias("a"), clean(said).alias("b"))
    return bound(cleaned, lambda x: bound(F.struct(x["a"].alias("a"), x["b"].alias("b"), goal_tokens(x["a"]).alias("ta"), goal_tokens(x["b"]).alias("tb")), scored))
