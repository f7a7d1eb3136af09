"""Records for training: prompts, messages, nested fields, and padded rollout layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.tokens import pad_left


def field(value: Column, *path: str) -> Column:
    """A nested field by its path, as the table's schema allows it."""
    for key in path:
        value = value[key]
    return value


def only(values: Column) -> Column:
    """The element of a list of one; null for any other size."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def record(source: str, prompt: Column, ability: str, style: str, truth: Column, split: str, index: Column) -> list[Column]:
    """The columns of a reinforcement-learning record."""
    return [
        F.lit(source).alias("data_source"),
        F.array(message("user", prompt)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info"),
    ]


def with_system(messages: Column, content: str) -> Column:
    """Messages behind a system message, whatever they begin with."""
    return F.array_prepend(messages, message("system", F.lit(content)))


def segments(content: Column) -> Column:
    """Typed parts of a text with <image> and <video> marks, in order; text between marks may be empty."""
    marked = F.regexp_replace(content, "(<image>|<video>)", "\u0000$1\u0000")
    kind = lambda x: F.when(x == "<image>", "image").when(x == "<video>", "video").otherwise("text")
    return F.transform(F.split(marked, "\u0000"), lambda x: F.struct(kind(x).alias("type"), F.when(kind(x) == "text", x).alias("text")))


def pad_right(ids: Column, width: int, fill: Column) -> Column:
    """Cut to ``width`` and padded to it."""
    return F.slice(F.concat(ids, F.array_repeat(fill, width)), 1, width)


def pair_ids(chosen: Column, rejected: Column, width: int, fill: Column) -> Column:
    """Two rows of ``width`` ids: chosen, then rejected."""
    return F.array(pad_right(chosen, width, fill), pad_right(rejected, width, fill))


def turn_mask(prompt: Column, turns: Column, prefix: int, suffix: int) -> Column:
    """The loss mask of a prompt of so many tokens and turns (role, n) behind it.

    Assistant turns count from their content to the end of their suffix; all else is 0.
    """
    off = lambda n: F.array_repeat(F.lit(0), n)
    one = lambda t: F.when(t["role"] == "assistant", F.concat(off(F.lit(prefix)), F.array_repeat(F.lit(1), t["n"] + suffix))).otherwise(off(t["n"] + (prefix + suffix)))
    return F.concat(off(prompt), F.flatten(F.transform(turns, one)))


def rollout_layout(prompt: Column, response: Column, prompt_width: int, response_width: int, fill: Column) -> Column:
    """Prompt padded left, response padded right: struct of ids, mask and positions.

    Positions count the prompt's tokens from 0 and go on through the whole response, padding included.
    """
    ids = F.concat(pad_left(prompt, prompt_width, fill), pad_right(response, response_width, fill))
    spots = F.sequence(F.lit(1), F.lit(prompt_width + response_width))
    first = prompt_width - F.size(prompt)
    used = lambda i: (i > first) & (i <= prompt_width + F.size(response))
    return F.struct(ids.alias("ids"), F.transform(spots, lambda i: used(i).cast("int")).alias("mask"), F.transform(spots, lambda i: F.greatest(i - first - 1, F.lit(0))).alias("positions"))


def dense_flops(tokens: Column, squares: Column, hidden: int, layers: int, heads: int, kv_heads: int, inner: int, vocabulary: int, head: int | None = None) -> Column:
    """Forward and backward operations of a dense transformer: six a weight and token, and attention by squared lengths."""
    head = head or hidden // heads
    weights = layers * (3 * hidden * inner + hidden * head * 2 * (heads + kv_heads)) + 2 * vocabulary * hidden
    return 6.0 * weights * tokens + 12.0 * layers * heads * head * squares


def chat(messages: Column, lead: str | None = None) -> Column:
    """Messages (role, content) as one text, a tagged line each; ``lead`` opens the next turn."""
    lines = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">"), m["content"], F.lit("\n"))), "")
    return F.concat(lines, F.lit(f"<{lead}>")) if lead else lines


def char_ids(text: Column) -> Column:
    """Code points as token ids: the default tokenizer where none is plugged in."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), _code_point))


def _code_point(character: Column) -> Column:
    return F.conv(F.hex(F.encode(character, "UTF-32")), 16, 10).cast("int")


def char_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.lpad(F.hex(i.cast("long")), 8, "0")), "UTF-32")), "")


def unpadded(ids: Column, valid: Column, end: Column) -> Column:
    """The first ``valid`` ids without the end mark."""
    return F.array_remove(F.slice(ids, F.lit(1), valid), end)


def cut_to(most: int, *names: str) -> list[Column]:
    return [F.slice(name, 1, most).alias(name) for name in names]


def passages(documents: Column) -> Column:
    """Retrieved documents as one text, numbered from 1: the first line is the title, the rest the text."""

    def one(content: Column, i: Column) -> Column:
        title = F.split_part(content, F.lit("\n"), F.lit(1))
        rest = F.substr(content, F.length(title) + 2)
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), rest, F.lit("\n\n"))

    return F.regexp_replace(F.array_join(F.transform(documents, one), ""), r"\A\s+|\s+\z", "")


def target(own: Column, golden: Column) -> Column:
    """The record's own ground truth, or else its list of golden answers."""
    return F.coalesce(own, golden)


def tool_call(arguments: Column) -> Column:
    """(arguments, failed): the JSON object as a map of texts; of anything else an empty map, and that it failed."""
    kind = F.schema_of_variant(F.try_parse_json(arguments))
    failed = ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    found = F.from_json(arguments, "map<string,string>")
    return F.struct(F.when(failed, F.create_map().cast("map<string,string>")).otherwise(found).alias("arguments"), failed.alias("failed"))


def metric_name(name: Column) -> Column:
    """A metric's name as trackers that forbid ``@`` take it."""
    return F.replace(name, F.lit("@"), F.lit("_at_"))
