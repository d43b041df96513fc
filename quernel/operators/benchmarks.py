"""Benchmark jobs: prompts, media of messages, judges, detection jobs, tool calls and the ladder of output comparisons."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import geometry as G
from quernel.functions import mathx
from quernel.functions import text as T

#: What judges are told, with worked examples, and how often they are asked.
TASK = "\nPlease read the following example.\nThen extract the answer from the model response and type it at the end of the prompt.\n\n"
HINTS = ("Hint: Please answer the question and provide the final answer at the end.", "Hint: Please answer the question and provide the correct option letter, e.g., A, B, C, D, at the end.")
EXAMPLES = (
    (0, "Which number is missing?", "The number missing in the sequence is 14.", "14"),
    (0, "What is the fraction of females facing the camera?", "The fraction of females facing the camera is 0.6,\nwhich means that six out of ten females in the group are facing the camera.", "0.6"),
    (0, "How much money does Luca need to buy a sour apple candy and a butter-scotch candy? (Unit: $)", "Luca needs $1.45 to buy a sour apple candy and a butterscotch candy.", "1.45"),
    (0, "Between which two years does the line graph saw its maximum peak?", "The line graph saw its maximum peak between 2007 and 2008.", "[2007, 2008]"),
    (1, "What fraction of the shape is blue?\n\nChoices: (A) 3/11 (B) 8/11 (C) 6/11 (D) 3/5", "The correct answer is (B) 8/11.", "B"),
)
TRIES, WARMER = 5, 0.5
DETECT = "Locate every instance that belongs to the following categories: '{}'. Report bbox coordinates in JSON format."
FACTOR, FEWEST_TOKENS, MOST_TOKENS, LONG_SIDE = 32, 768, 12800, 50000
CODE_HEAD = "You are required to solve a programming problem. Please enclose your code inside a ```python``` block.  Do not write a main() function. If Call-Based format is used, return the result in an appropriate place instead of printing it.\n\n"
STANDARD, CALLED = "\nPlease write your code using Standard IO, i.e. input() and print().", "\nPlease write your code using Call-Based format."
STARTER = "\nThe starter code is provided as below. Please finish the code.\n"
#: The actions of the phone and computer tools and what each needs.
PHONE = {"key": ["text"], "click": ["coordinate"], "long_press": ["coordinate", "time"], "swipe": ["coordinate", "coordinate2"], "type": ["text"], "system_button": ["button"], "open": ["text"], "wait": ["time"], "terminate": ["status"]}
COMPUTER = {
    "key": ["keys"], "type": ["text"], "mouse_move": ["coordinate"], "left_click": [], "left_click_drag": ["coordinate"], "right_click": [], "middle_click": [], "double_click": [],
    "triple_click": [], "scroll": ["pixels"], "hscroll": ["pixels"], "wait": ["time"], "terminate": ["status"], "answer": ["text"],
}


# ---- Prompts


def worked_examples() -> list[str]:
    return [f"\n{HINTS[hint]}\n\nQuestion: {question}\n\nModel response: {said}\n\nExtracted answer: {answer}\n" for hint, question, said, answer in EXAMPLES]


def extraction_prompt(question: Column, prediction: Column) -> Column:
    """What a judge is asked to extract an answer: the worked examples, then the question and the response."""
    return F.concat(F.lit(TASK + "".join(e + "\n" for e in worked_examples())), question, F.lit("\nModel response: "), prediction.cast("string"), F.lit("\nExtracted answer: "))


def picture_prompt(question: Column, images: Column, least: int = 768 * 28 * 28, most: int = 5120 * 28 * 28) -> Column:
    """Content parts: all images with their limits of pixels, then the question."""
    part = lambda kind, value, low, high: F.struct(F.lit(kind).alias("type"), value.alias("value"), low.alias("min_pixels"), high.alias("max_pixels"))
    none = F.lit(None).cast("int")
    return F.concat(F.transform(images, lambda i: part("image", i, F.lit(least), F.lit(most))), F.array(part("text", question, none, none)))


def detection_prompt(classes: Column) -> Column:
    before, after = DETECT.split("{}")
    return F.concat(F.lit(before), F.array_join(classes, ", "), F.lit(after))


def code_prompt(question: Column, starter: Column, function: Column) -> Column:
    """A programming problem: by calls where there is a function's name or starter code, else by input and output."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    begun = F.when(has(starter), F.concat(F.lit(STARTER), starter, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(CODE_HEAD + "\nQUESTION:\n"), question, F.when(has(starter) | has(function), CALLED).otherwise(STANDARD), begun, F.lit("\nANSWER:\n"))


# ---- Media of messages

PART = "struct<type:string,text:string,image:string,image_url:string,video:string>"


def vision_parts(conversations: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """(key, pos, kind, medium): the parts of all messages that hold an image or a video, in order. A message whose content is a text has none.

    ``messages``: an array of (role, parts array of ``PART``). An image goes before a video of one part; a part that only says it is one fails the job.
    """
    flat = conversations.select(key, F.posexplode(F.flatten(F.transform(messages, lambda m: F.coalesce(m["parts"], F.array().cast(f"array<{PART}>"))))).alias("pos", "p"))
    image = F.coalesce("p.image", "p.image_url")
    said = F.coalesce("p.type", F.lit("text")).isin("image", "image_url", "video")
    held = flat.filter(image.isNotNull() | F.col("p.video").isNotNull() | said)
    medium = F.coalesce(image, "p.video", F.raise_error(F.lit("a part has neither an image nor a video")).cast("string"))
    return held.select(key, "pos", F.when(image.isNotNull(), "image").otherwise("video").alias("kind"), medium.alias("medium"))


def routed(parts: DataFrame, key: str) -> DataFrame:
    """Each conversation's images and videos, null where there are none."""
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "medium"))))
    out = parts.groupBy(key).agg(listed("image").alias("i"), listed("video").alias("v"))
    media = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: x["medium"]))
    return out.select(key, media(F.col("i")).alias("images"), media(F.col("v")).alias("videos"))


# ---- Judges


def asked(rows: DataFrame, prompt: str, judge: Callable[[str, float], str], tries: int = TRIES) -> DataFrame:
    """Add ``judged``: what a judge makes of each prompt, asked again, warmer each time, while it fails; null if it always does, or without a prompt.

    The judge runs on the executors, batch by batch; without one, the rules stand alone (no query here has one).
    """
    schema = rows.withColumn("judged", F.lit(None).cast("string")).schema

    def one(text: str | None) -> str | None:
        for k in range(tries if text is not None else 0):
            try:
                said = judge(text, k * WARMER)
            except Exception:  # noqa: BLE001  whatever a judge raises is a failed try
                continue
            if said is not None and T.FAILED not in said:
                return said
        return None

    def ask(frames):
        for pdf in frames:
            yield pdf.assign(judged=pd.Series([one(t) for t in pdf[prompt]], index=pdf.index, dtype=object))

    return rows.mapInPandas(ask, schema)


def extracted(rows: DataFrame, options: Column, judge: Callable[[str, float], str] | None = None) -> DataFrame:
    """Add ``res`` and ``extract_model`` (rule, judge or none): the rules first, then the judge for what they leave.

    Columns question, prediction and answer. A rule's Z is a refusal: taken, but not a success.
    """
    picked = mathx.checked(F.col("prediction"), F.col("answer"), options, prefetch=True)
    ruled = rows.withColumn("_r", picked)
    if judge is not None:
        prompt = F.when(F.col("_r").isNull(), extraction_prompt(F.col("question"), F.col("prediction")))
        ruled = asked(ruled.withColumn("_p", prompt), "_p", judge).drop("_p").withColumnRenamed("judged", "_j")
    else:
        ruled = ruled.withColumn("_j", F.lit(None).cast("string"))
    model = F.when(F.col("_r").isNotNull(), "rule").when(F.col("_j").isNotNull(), "judge").otherwise("none")
    good = F.col("_r").isNotNull() & (F.col("_r") != "Z") | F.col("_j").isNotNull() & F.col("_r").isNull()
    return ruled.withColumns({"res": F.coalesce("_r", "_j", F.lit("")), "extract_model": model, "extract_flag": good}).drop("_r", "_j")


# ---- Detection jobs


def detection_jobs(images: DataFrame, annotations: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each image: its number, path, sizes before and after, prompt and gold boxes.

    ``images``: dataset, img_id, file_name, height, width; ``annotations``: dataset, img_id, category_id, bbox; ``sets``: dataset, folder, classes. Numbers follow
    the data sets' names and the images' ids.
    """
    unit = FACTOR * FACTOR
    size = G.resized(F.col("height"), F.col("width"), FACTOR, unit * FEWEST_TOKENS, unit * MOST_TOKENS, long_side=LONG_SIDE)
    gold = annotations.groupBy("dataset", "img_id").agg(F.array_sort(F.collect_list(F.struct("category_id", "bbox"))).alias("annotation"))
    known = images.join(sets, "dataset").join(gold, ["dataset", "img_id"], "left").withColumn("r", size)
    return known.select(
        "dataset", "img_id", F.concat("folder", "file_name").alias("img_path"), F.col("height").alias("img_h"), F.col("width").alias("img_w"), F.col("r.height").alias("resized_h"), F.col("r.width").alias("resized_w"),
        detection_prompt(F.col("classes")).alias("prompt"), "annotation",
    )


# ---- Tools


def tool_call(text: Column, actions: dict[str, list[str]]) -> Column:
    """A tool's call from JSON: the action and its arguments as a map; an unknown action or one without what it needs is null."""
    held = F.from_json(text, "map<string,string>")
    action = F.element_at(held, "action")
    needed = F.create_map(*(x for name, keys in actions.items() for x in (F.lit(name), F.array(*map(F.lit, keys)).cast("array<string>"))))
    there = F.forall(F.coalesce(F.element_at(needed, action), F.array(F.lit("\u0000"))), lambda k: F.map_contains_key(held, k))
    return F.when(there, F.struct(action.alias("action"), F.map_filter(held, lambda k, v: k != "action").alias("arguments")))


# ---- Outputs of programs


def output_matches_of(output: list, wanted) -> bool:
    """Whether printed lines (or a returned value) are the wanted ones: as they are, stripped, line by line, as numbers, or as sets of words and numbers."""

    def tried(test: Callable[[], bool]) -> bool:
        try:
            return bool(test())
        except (TypeError, ValueError, IndexError, AttributeError, KeyError):
            return False

    if isinstance(wanted, str) and isinstance(output, list) and all(isinstance(o, str) for o in output):
        if "\n".join(output).strip() == wanted.strip() or "\n".join(o.strip() for o in output).strip() == wanted.strip():
            return True
    lines = wanted if isinstance(wanted, list) else [x.strip() for x in str(wanted).split("\n") if x]
    near = lambda a, b: len(a) == len(b) and all(abs(float(x) - float(y)) <= 1e-8 + 1e-5 * abs(float(y)) for x, y in zip(a, b))
    bags = lambda rows, by: {frozenset(by(w) for w in str(r).split()) for r in rows if str(r).split()}
    return (
        tried(lambda: output in ([wanted], wanted, lines, [lines]))
        or tried(lambda: [o.strip() for o in output] == lines)
        or tried(lambda: near(output, lines))
        or tried(lambda: near(output[0], lines[0]))
        or tried(lambda: bags(output, str) == bags(lines, str))
        or tried(lambda: bags(output, lambda w: round(float(w), 3)) == bags(lines, lambda w: round(float(w), 3)))
    )


def output_matches(output: Column, wanted: Column) -> Column:
    """The same for JSON columns: what was printed or returned, and what was wanted. Programs are never run here."""

    @F.pandas_udf("boolean")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else output_matches_of(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype=object)

    return F.coalesce(compare(output, wanted), F.lit(False))
