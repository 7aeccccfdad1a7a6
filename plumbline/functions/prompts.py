"""Prompt columns. JSON is built with `to_json`, which keeps field order and leaves null fields out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.binding import let
from plumbline.functions import fixed

MESSAGE = "struct<role:string,content:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def json_string(c: Column) -> Column:
    """`c` as a JSON string literal."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_value(value: Column, is_text: Column) -> Column:
    """A JSON value: text is quoted, anything else is already JSON and goes in unchanged (key order kept)."""
    return F.when(is_text, json_string(value)).otherwise(value)


def label_at(i: Column) -> Column:
    """The label of the option at place `i` from 0: A to Z, then AA, AB, ..., so that no two options share one."""
    n = len(fixed.LETTERS)
    one = lambda at: F.substring(F.lit(fixed.LETTERS), at + 1, F.lit(1))
    return F.when(i < n, one(i)).otherwise(F.concat(one(F.floor(i / n).cast("int") - 1), one(i % n)))


def lettered(options: Column, reverse: bool = False) -> Column:
    """Options with letters A, B, ... in the order shown."""
    shown = F.reverse(options) if reverse else options
    return F.transform(shown, lambda o, i: F.struct(
        label_at(i).alias("label"), o["key"].alias("key"),
        o["description"].alias("description")))


def letter_of(options: Column, key: Column) -> Column:
    return let(F.array_position(F.transform(options, lambda o: o["key"]), key).cast("int"), lambda at: F.when(at > 0, label_at(at - 1)).otherwise(""))


def _facts_part(facts: Column) -> Column:
    return F.when(F.size(facts) > 0, F.concat(F.lit(',"facts":'), F.to_json(facts))).otherwise(F.lit(""))


def decision_body(question: Column, options: Column, state_json: Column, facts: Column,
                  examples: Column | None = None, reverse: bool = False) -> Column:
    """The compact user turn: question, lettered options, solved examples, then the state and its date facts.
    `examples` is an array of (state_json, facts, gold)."""
    shown = F.reverse(options) if reverse else options
    shots = F.lit("")
    if examples is not None:
        one = F.transform(examples, lambda e: F.concat(
            F.lit('{"state":'), e["state_json"], _facts_part(e["facts"]), F.lit(',"answer":"'),
            letter_of(shown, e["gold"]), F.lit('"}')))
        shots = F.when(F.size(examples) > 0, F.concat(F.lit(',"examples":['), F.array_join(one, ","), F.lit("]"))
                       ).otherwise(F.lit(""))
    return F.concat(F.lit('{"question":'), json_string(question), F.lit(',"options":'),
                    F.to_json(lettered(options, reverse)), shots, F.lit(',"state":'), state_json,
                    _facts_part(facts), F.lit("}"))


def decision_messages(body: Column, explain: Column | bool = False) -> Column:
    flag = F.lit(explain) if isinstance(explain, bool) else explain
    system = F.when(flag, F.lit(fixed.EXPLAIN_PROMPT)).otherwise(F.lit(fixed.SYSTEM_PROMPT))
    return F.array(message("system", system), message("user", body))


def item_json(state_json: Column, question: Column, options: Column) -> Column:
    return F.concat(F.lit('{"state":'), state_json, F.lit(',"question":'), json_string(question),
                    F.lit(',"options":'), F.to_json(lettered(options)), F.lit("}"))


def turn_messages(state_json: Column, question: Column, options: Column, examples: Column,
                  explain: bool = False) -> Column:
    """The chat form: each example is a solved earlier turn that repeats question and options."""
    system = fixed.EXPLAIN_PROMPT if explain else fixed.SYSTEM_PROMPT
    solved = F.flatten(F.transform(examples, lambda e: F.array(
        message("user", item_json(e["state_json"], question, options)),
        message("assistant", letter_of(options, e["gold"])))))
    return F.concat(F.array(message("system", F.lit(system))), solved,
                    F.array(message("user", item_json(state_json, question, options))))


def knowledge_messages(messages: Column, passages: Column) -> Column:
    """One system turn (the caller's own system text, the instruction, numbered passages), then the other turns."""
    own = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"])
    numbered = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))
    body = F.when(F.size(passages) > 0, F.array_join(numbered, "\n\n")).otherwise(F.lit(fixed.NOTHING_FOUND))
    system = F.array_join(F.concat(own, F.array(F.lit(fixed.KNOWLEDGE_PROMPT),
                                                F.concat(F.lit(fixed.KNOWLEDGE_MARK), body))), "\n\n")
    return F.concat(F.array(message("system", system)), F.filter(messages, lambda m: m["role"] != "system"))


def knowledge_of(messages: Column) -> Column:
    """What follows the first knowledge mark in the first system turn that has one; null when none has."""
    holding = F.filter(messages, lambda m: (m["role"] == "system") & m["content"].contains(fixed.KNOWLEDGE_MARK))
    content = F.get(holding, 0)["content"]
    at = F.instr(content, fixed.KNOWLEDGE_MARK)
    return F.when(at > 0, F.substring(content, at + len(fixed.KNOWLEDGE_MARK), F.length(content)))


def summary_messages(body: Column, focus: Column | None = None) -> Column:
    ask = F.lit(fixed.SUMMARY_PROMPT)
    if focus is not None:
        ask = F.concat(ask, F.when(F.coalesce(focus, F.lit("")) != "", F.concat(F.lit(" Focus on: "), focus, F.lit(".")))
                       .otherwise(F.lit("")))
    return F.array(message("user", F.concat(ask, F.lit("\n\n"), body)))
