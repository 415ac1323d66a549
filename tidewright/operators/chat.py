"""Conversations: normalising, rendering, masked sequences and the rolling prompt window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bound, sums_to_end

# Fixed values of the rendered format, and the label that a loss ignores.
USER_PREFIX, BOT_PREFIX, TURN_SEP, IGNORE = "User: ", "Pirate: ", "\n", -100


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns (array of role and text in order) of a long table (conv_id, turn, role, text).

    Texts are stripped and empty ones go; the role assistant is a bot, any other a user. Conversations
    without a bot, or with fewer than two turns, go too."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")
    rows = turns.select("conv_id", "turn", F.when(F.col("role") == "assistant", "bot").otherwise("user").alias("role"), text.alias("text")).where("text <> ''")
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    out = out.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return out.where(F.exists("turns", lambda t: t["role"] == "bot") & (F.size("turns") >= 2))


def instructions(df: DataFrame) -> DataFrame:
    """conv_id and turns of instruction rows (conv_id, instruction, context, response); empty instructions or responses go."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")
    rows = df.select("conv_id", clean(F.col("instruction")).alias("i"), clean(F.col("context")).alias("c"), clean(F.col("response")).alias("r")).where("i <> '' AND r <> ''")
    user = F.when(F.col("c") != "", F.concat("i", F.lit("\n"), "c")).otherwise(F.col("i"))
    return rows.select("conv_id", F.array(F.struct(F.lit("user").alias("role"), user.alias("text")), F.struct(F.lit("bot").alias("role"), F.col("r").alias("text"))).alias("turns"))


def map_bot(turns: Column, rewrite) -> Column:
    """The turns with ``rewrite`` applied to what the bot says."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.when(t["role"] == "bot", rewrite(t["text"])).otherwise(t["text"]).alias("text")))


def rewrite_bot(convs: DataFrame, phrases: DataFrame, endings: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(conv_id, turns) with what the bot says rewritten by a table of phrases; see rewrite(). Turns are rewritten as rows and put together again."""
    from .rewrite import rewrite

    rows = convs.select("conv_id", F.posexplode("turns").alias("_at", "t")).select("conv_id", "_at", F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    new = rewrite(rows.where("role = 'bot'"), "text", phrases, endings).unionByName(rows.where("role <> 'bot'"))
    return new.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def lead(role: Column, first: Column) -> Column:
    """What stands before a turn's text: a separator but for the first, and the role's prefix."""
    return F.concat(F.when(first, "").otherwise(TURN_SEP), F.when(role == "user", USER_PREFIX).otherwise(BOT_PREFIX))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t, i: F.concat(lead(t["role"], i == 0), t["text"])), "")


def instruction_prompt(instruction: Column) -> Column:
    """The prompt for a single instruction, stripped of outer white space. A fixed format, another one than that of conversations."""
    return F.concat(F.lit("### Instruction:\n"), F.regexp_replace(instruction, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", ""), F.lit("\n\n### Response:\n"))


def whole_text_tokens(text: Column) -> Column:
    """Stand-in tokens: the length in code points of each run of letters, spaces or signs. Any array<int> expression will do instead."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\s?[^\s]+|\s"), F.lit(0)), lambda w: F.length(w))


def masked(turns: Column, tokens, eos: int, block: int) -> Column:
    """struct of input_ids, labels, truncated and n (before padding); null if nothing is left to learn.

    User turns and cues are masked; a bot's text and its end token are learned. The cue and the text are
    encoded apart, so no token spans them. Too long sequences lose their left part, short ones are padded
    with the end token, masked."""
    ignore = F.lit(IGNORE)

    def part(t: Column, i: Column) -> Column:
        cue = lead(t["role"], i == 0)
        user = tokens(F.concat(cue, t["text"]))
        head, body = tokens(cue), F.concat(tokens(t["text"]), F.array(F.lit(eos)))
        mask = lambda a: F.transform(a, lambda _: ignore)
        bot = t["role"] != "user"
        return F.struct(F.when(bot, F.concat(head, body)).otherwise(user).alias("ids"), F.when(bot, F.concat(mask(head), body)).otherwise(mask(user)).alias("labels"))

    def cut(s: Column) -> Column:
        n = F.size(s["ids"])
        last = lambda a: F.when(n > block, F.slice(a, F.greatest(n - block, F.lit(0)) + 1, block)).otherwise(a)
        ids, labels = last(s["ids"]), last(s["labels"])
        pad = F.greatest(F.lit(block) - n, F.lit(0))
        out = F.struct(F.concat(ids, F.array_repeat(F.lit(eos), pad)).alias("input_ids"), F.concat(labels, F.array_repeat(ignore, pad)).alias("labels"), (n > block).alias("truncated"), F.least(n, F.lit(block)).alias("n"))
        return F.when(F.exists(labels, lambda x: x != IGNORE), out)

    joined = F.transform(F.array(F.transform(turns, part)), lambda p: F.struct(F.flatten(F.transform(p, lambda x: x["ids"])).alias("ids"), F.flatten(F.transform(p, lambda x: x["labels"])).alias("labels")))
    return F.element_at(F.transform(joined, cut), 1)


def shifted(example: Column) -> Column:
    """struct of x and y for next-token training: ids without the last, labels without the first."""
    n = F.size(example["input_ids"])
    return F.struct(F.slice(example["input_ids"], 1, n - 1).alias("x"), F.slice(example["labels"], 2, n - 1).alias("y"))


def prompt_window(turns: Column, tokens, eos: int, block: int, reserve: int) -> Column:
    """Ids of the latest turns that fit, with the bot's cue: the oldest turns go until the rest fits.

    What is left is cut to its last ids. A turn that becomes the first loses its separator, so its
    ids depend on where the window starts; both forms are encoded once."""
    budget = max(1, block - reserve)

    def encode(t: Column, first: bool) -> Column:
        cue = lead(t["role"], F.lit(first))
        return F.when(t["role"] == "user", tokens(F.concat(cue, t["text"]))).otherwise(F.concat(tokens(cue), tokens(t["text"]), F.array(F.lit(eos))))

    both = F.transform(turns, lambda t: F.struct(encode(t, True).alias("head"), encode(t, False).alias("tail")))
    cue = lambda some: tokens(F.lit((TURN_SEP if some else "") + BOT_PREFIX))

    def window(p: Column) -> Column:
        n, end = F.size(p), cue(True)

        def latest(after: Column) -> Column:
            """``after`` has the sizes of the turns from each one on, as they are when they aren't the first."""
            rest = lambda i: F.coalesce(F.get(after, i + 1), F.lit(0)) + F.size(end)
            fits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.size(F.get(p, i)["head"]) + rest(i) <= budget) | (i == n - 1))
            return bound(F.array_min(fits), lambda start: F.concat(F.get(p, start)["head"], F.flatten(F.transform(F.slice(p, start + 2, n), lambda t: t["tail"])), end))

        joined = bound(sums_to_end(F.transform(p, lambda t: F.size(t["tail"]))), latest)
        return bound(joined, lambda ids: F.slice(ids, F.greatest(F.size(ids) - budget, F.lit(0)) + 1, budget))

    return F.when(F.size(turns) > 0, bound(both, window)).otherwise(F.slice(cue(False), F.greatest(F.size(cue(False)) - budget, F.lit(0)) + 1, budget))


def examples(convs: DataFrame, tokens, eos: int, block: int, val_fraction: float = 0.02, seed: int = 1337, rewrite=None) -> DataFrame:
    """conv_id, split, input_ids, labels, truncated of (conv_id, turns): rewritten, masked, shuffled and split.

    Conversations without anything to learn go; the validation part has max(1, floor(n * fraction)) rows."""
    from .corpus import fraction_split

    if rewrite is not None:
        convs = convs.withColumn("turns", map_bot(F.col("turns"), rewrite))
    rows = convs.select("conv_id", masked(F.col("turns"), tokens, eos, block).alias("e")).where("e IS NOT NULL").select("conv_id", "e.input_ids", "e.labels", "e.truncated")
    return fraction_split(rows, "conv_id", val_fraction, seed)


def summary(convs: DataFrame, built: DataFrame) -> DataFrame:
    """n, skipped, truncated and the share of truncated examples."""
    n = convs.agg(F.count("*").alias("all"))
    out = built.agg(F.count("*").alias("n"), F.count_if("truncated").alias("truncated")).join(n)
    return out.select("n", (F.col("all") - F.col("n")).alias("skipped"), "truncated", (F.col("truncated") / F.greatest("n", F.lit(1))).alias("truncated_share"))


def batches(built: DataFrame, n: int, size: int, seed: int = 1337) -> DataFrame:
    """batch, place, x, y: n batches of ``size`` examples drawn with replacement, shifted for next-token training."""
    from .order import digest, ordered_index

    rows = ordered_index(built, "conv_id", name="_at")
    total = built.count()
    draws = built.sparkSession.range(n * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("place"), (digest(F.col("id"), seed) % max(1, total)).alias("_at"))
    return draws.join(rows, "_at").select("batch", "place", shifted(F.struct("input_ids", "labels")).alias("s")).select("batch", "place", "s.x", "s.y")
