"""Text cleaning, prompts and answers as column expressions, and Arrow functions where those cannot express them.

Java's ``\\s`` and ``.`` differ from what is meant here, so white space is Unicode's (``(?U)``) and only a line feed
ends a line.
"""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import let

SPACE = r"(?U)\s+"
PUNCTUATION = ".,;:!?\"'()[]{}"
ANSWER_EDGE = " \t\r\n*_`\"'.,;:!?()[]"

# Prompt texts that answers were collected with, and personas that paraphrases are asked for.
SYSTEM = (
    "You answer factual multi-hop questions. Use ONLY the information in the provided context paragraphs (if any). "
    "If the context does not contain the answer, reply with the single word: unknown. Answer in a brief phrase or a "
    "single sentence — do not add reasoning, citations, or follow-up prose."
)
ASK = "Question: {question}\n\nAnswer:"
COT_SYSTEM = (
    "You answer factual multi-hop questions by reasoning step by step. Use ONLY the information in the provided context "
    "paragraphs (if any). Work through the question one hop at a time: on each line, state one intermediate conclusion "
    "you can draw, naming the specific entity, date, or fact for that step. After the reasoning, write the final answer "
    "on a new line that starts exactly with 'Answer:'. If the context does not let you resolve a step, state what is "
    "missing for that step and continue."
)
COT_ASK = "Question: {question}\n\nReason step by step, then end with a line starting 'Answer:'."
PERSONAS = {
    "neutral": "Rewrite the question in clear, neutral, encyclopedia-style English. Avoid colloquialisms, opinions, or stylistic flourish.",
    "journalist": "Rewrite the question as a news journalist would phrase it for a factual article. Be precise, attribute nothing, use a professional register, and prefer active voice.",
    "casual_user": "Rewrite the question as a casual user might type it into a chatbot or web search box. Informal but not slang-heavy; you may drop articles or use contractions; questions phrased as imperatives or even fragments are fine, as long as the meaning is preserved.",
    "domain_expert": "Rewrite the question as a domain expert would phrase it among colleagues. Precise terminology, slightly higher register, can assume some shared background but must remain self-contained.",
    "student": "Rewrite the question as an inquisitive student studying the topic would ask it: plain and direct, possibly opening with 'Can you tell me' or 'I want to know'. Keep every entity and constraint that fixes the answer.",
    "terse_keyword": "Rewrite the question as a terse keyword / search-style query: telegraphic, drop articles and filler words, but KEEP every named entity, relation, and constraint that determines the answer. It need not be a grammatical sentence.",
    "formal_academic": "Rewrite the question in a formal academic register, as in a scholarly reference work: complete sentences, precise wording, no contractions or colloquialisms.",
    "second_language": "Rewrite the question as a careful non-native English speaker would: simple, grammatical sentences and common vocabulary, phrasing that may be slightly literal, with the meaning fully preserved.",
}
REWRITE_SYSTEM = (
    "You are a careful paraphrase generator. Your task is to rewrite a single question so the answer set is preserved "
    "bit-for-bit. The rewritten question MUST have the same correct answer (and the same set of acceptable answers) as "
    "the original. You MAY change wording, word order, syntax, and tone. You MUST NOT add or remove information that "
    "would change which answers are correct. You MUST NOT answer the question.\n\nOutput exactly one line: the rewritten "
    "question. No preamble, no explanation, no surrounding quotes, no trailing notes."
)
REWRITE_ASK = (
    "Persona to write as: {persona}\n\nOriginal question:\n{question}\n\nRewritten question (one line, in the persona "
    "above, with the same answer set as the original):"
)
LABELS = ("answer", "final answer", "the answer", "the final answer")


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def without_tags(text: Column) -> Column:
    return squeezed(F.regexp_replace(text, "<[^>]+>", ""))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities resolved."""
    return text.map(html.unescape, na_action="ignore")


def snippet(text: Column) -> Column:
    """Entities, then tags, then white space."""
    return without_tags(unescaped(text))


def one_line(text: Column) -> Column:
    """The first line, trimmed, less one layer of matching quotes."""
    line = F.trim(F.element_at(F.split(F.trim(text), "\n"), 1))
    return F.trim(F.regexp_replace(line, "^(?s)([\"'`])(.*)\\1$", "$2"))


def normal(text: Column) -> Column:
    """Lower case, one space, no punctuation at the ends."""
    return F.btrim(squeezed(F.lower(text)), F.lit(PUNCTUATION))


def bare(text: Column) -> Column:
    """Lower case with only letters, digits, underscores and single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s]", ""), SPACE, " ")


def exact_match(gold: Column, answer: Column) -> Column:
    return (bare(gold) == bare(answer)).cast("int")


def tokens(text: Column) -> Column:
    return F.filter(F.split(squeezed(F.lower(text)), " "), lambda w: w != "")


def word_set(text: Column) -> Column:
    """The different words of a text: runs of letters, digits and underscores in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != ""))


def truth(value: Column) -> Column:
    """1, 0 or null of a rater's mark."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("1", "yes", "y", "true", "t"), 1).when(v.isin("0", "no", "n", "false", "f"), 0)


def stopped(text: Column, stops: list[str]) -> Column:
    """The text up to its earliest stop string."""
    at = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops if s]
    if not at:
        return text
    least = F.array_min(F.array(*at))
    return F.when(least.isNull(), text).otherwise(F.substring(text, F.lit(1), least - 1))


def context_block(paragraphs: Column) -> Column:
    """``Title: body`` of each paragraph (``title, sentences``) with a body, blank lines between."""
    body = lambda p: F.trim(F.array_join(p["sentences"], ""))
    full = F.filter(paragraphs, lambda p: body(p) != "")
    return F.array_join(F.transform(full, lambda p: F.concat(p["title"], F.lit(": "), body(p))), "\n\n")


def messages(system: str, user: Column) -> Column:
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(system)), say("user", user))


def qa_messages(question: Column, paragraphs: Column, reasoning: bool = False) -> Column:
    """System and user message; no context block where there is no paragraph."""
    ask = COT_ASK if reasoning else ASK
    asked = F.concat(F.lit("Question: "), F.trim(question), F.lit(ask.partition("{question}")[2]))
    user = F.when(F.coalesce(F.size(paragraphs), F.lit(0)) > 0, F.concat(F.lit("Context:\n"), context_block(paragraphs), F.lit("\n\n"), asked)).otherwise(asked)
    return messages(COT_SYSTEM if reasoning else SYSTEM, user)


def rewrite_messages(question: Column, persona: Column) -> Column:
    head, _, tail = REWRITE_ASK.partition("{persona}")
    middle, _, end = tail.partition("{question}")
    return messages(REWRITE_SYSTEM, F.concat(F.lit(head), persona, F.lit(middle), F.trim(question), F.lit(end)))


def scaffold(hops: Column, k: Column) -> Column:
    """The first ``k`` hops (``sub_question, sub_answer``) as lines."""
    some = F.slice(hops, F.lit(1), k)
    return F.array_join(F.transform(some, lambda h: F.concat(F.lit("- "), h["sub_question"], F.lit(" -> "), h["sub_answer"])), "\n")


# How models mark their answers. Java's white space lacks four separators, which are named.
MARKED = r"(?imdU)^[ \t>#*_\-]*(?:final[\s\x1C-\x1F]+answer|answer)[ \t*_]*[:\-–—][ \t]*(.*)$"
SPOKEN = r"(?isU)\b(?:the[\s\x1C-\x1F]+)?(?:final[\s\x1C-\x1F]+)?answer[\s\x1C-\x1F]+(?:is|was|would[\s\x1C-\x1F]+be)\b[:\s\x1C-\x1F]*(.+?)[.\n]"
BLANK = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def _span(text: Column) -> Column:
    """A text less emphasis, quotes and punctuation around it; null if nothing is left, or only a label."""
    return let(stripped(F.btrim(stripped(text), F.lit(ANSWER_EDGE))), lambda s: F.when((s != "") & ~F.lower(s).isin(*LABELS), s))


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def answer(response: Column) -> Column:
    """A response's answer, empty if it has none.

    Its lines are numbered spans. The last marked line's own span comes first, then the first span below any marked line,
    then the last sentence that says what the answer is, then the last span of all.
    """

    def chosen(r: Column) -> Column:
        marks, lines = r["marks"], r["lines"]
        spans = F.transform(lines, _span)
        below = F.filter(spans, lambda s, i: s.isNotNull() & (i >= r["top"]))
        return F.coalesce(
            _span(_last(marks)), F.when(F.size(marks) > 0, F.get(below, F.lit(0))), _span(_last(r["said"])), _last(F.array_compact(spans)), F.lit("")
        )

    def parts(text: Column) -> Column:
        lines = F.split(text, LINE_END)
        # numbered from 0, so the place of the first marked line, counted from 1, is the number of the line below it
        top = let(F.array_position(F.transform(lines, lambda x: x.rlike(MARKED)), True), lambda at: F.when(at > 0, at).otherwise(F.size(lines)))
        return F.struct(
            F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)).alias("marks"), F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(SPOKEN), F.lit(1)).alias("said"), lines.alias("lines"), top.alias("top")
        )

    return let(let(stripped(F.coalesce(response, F.lit(""))), parts), chosen)


FENCED = r"(?sU)^```(?:json)?\s*(.*?)\s*```\z"


def _reply(text: Column) -> Column:
    """``word, json`` of a judge's reply: what a fence holds, from its first brace to its last if prose stands around them, and its value."""
    word = let(F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), FENCED, "$1"), lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r"(?s)^[^{].*?(\{.*\})", 1), F.lit("")), s))
    # as the one element of a list, so that nothing may follow the value
    return let(word, lambda w: F.struct(F.lower(w).alias("word"), F.try_parse_json(F.concat(F.lit("["), w, F.lit("]"))).alias("json")))


def _kind(value: Column) -> Column:
    """The type of a JSON value: ``VOID``, ``STRING``, ``BOOLEAN``, ``BIGINT``, ``DECIMAL``, ``DOUBLE``, ``ARRAY`` or ``OBJECT``; null if it is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _at(json: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(json, path, kind)


def verdict(text: Column) -> Column:
    """A judge's yes or no: true, false, yes, no, or an object whose ``valid`` is a boolean or its name; null if it says none."""

    def said(r: Column) -> Column:
        alone, valid = _at(r["json"], "$[0]"), _at(r["json"], "$[0].valid")
        single = _at(r["json"], "$[1]").isNull()
        named = stripped(F.lower(_at(r["json"], "$[0].valid", "string")))
        return (
            F.when(r["json"].isNull(), F.when(r["word"] == "yes", True).when(r["word"] == "no", False))
            .when(single & (_kind(alone) == "BOOLEAN"), _at(r["json"], "$[0]", "boolean"))
            .when(single & (_kind(valid) == "BOOLEAN"), _at(r["json"], "$[0].valid", "boolean"))
            .when(single & (_kind(valid) == "STRING"), F.when(named == "true", True).when(named == "false", False))
        )

    return let(_reply(text), said)


def listed_answers(text: Column) -> Column:
    """The answers that a judge lists (``answers``, or ``Answers`` if that is empty): texts, numbers and booleans; empty if it lists none."""
    number = lambda x: F.try_variant_get(x, "$", "double").cast("string")
    plain = lambda x: F.try_variant_get(x, "$", "string")

    def shown(x: Column) -> Column:
        return let(_kind(x), lambda k: F.when(k.isin("STRING", "BIGINT"), plain(x)).when(k == "BOOLEAN", F.initcap(plain(x))).when(k.isin("DECIMAL", "DOUBLE", "FLOAT"), number(x)))

    def listed(r: Column) -> Column:
        first = F.to_json(_at(r["json"], "$[0].answers"))
        empty = first.isNull() | first.isin("null", "[]", "{}", '""', "0", "0.0", "false")
        some = F.when(empty, _at(r["json"], "$[0].Answers", "array<variant>")).otherwise(_at(r["json"], "$[0].answers", "array<variant>"))
        kept = F.array_compact(F.transform(some, shown))
        return F.coalesce(F.when(_at(r["json"], "$[1]").isNull(), kept), F.array().cast("array<string>"))

    return let(_reply(text), listed)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance over lower-case words: each different word of the two texts becomes one character.

    Words are split off once a row: inside lambdas of one-element arrays, they are values that Spark cannot work out again.
    """
    split = F.transform(F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.array_distinct(F.concat(p["x"], p["y"])).alias("words")))
    # characters beyond the basic plane, so that none is a surrogate
    letter = lambda w, words: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 0x10000), 8, "0")), "UTF-32")
    spelled = lambda ws, words: F.array_join(F.transform(ws, lambda w: letter(w, words)), "")
    return F.get(F.transform(split, lambda p: F.levenshtein(spelled(p["x"], p["words"]), spelled(p["y"], p["words"]))), F.lit(0))


@F.pandas_udf(T.StringType())
def request_key(body: pd.Series) -> pd.Series:
    """SHA-256 of a request's canonical JSON: keys sorted, no spaces, ASCII only, nulls kept."""
    from hashlib import sha256

    canonical = lambda s: json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return body.map(lambda s: sha256(canonical(s).encode()).hexdigest(), na_action="ignore")
