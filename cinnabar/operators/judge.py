"""Operators that ask an external judge, such as a language model, about code.

A judge is a function from a prompt to a response's text, made on each executor by a picklable factory, so that a
connection isn't shipped.  Two come with the library and need no network: rule_judge answers from the code itself,
recorded_judge from a table of earlier answers.  A response is read as the JSON between its outermost braces.

Null or empty names or code aren't asked about.  Pairs that a judge fails on aren't similar; a whole-set answer that can't
be read is an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinnabar.exceptions import AnalysisError, ConfigurationError
from cinnabar.functions import text as X
from cinnabar.functions.parsing import dedent

Judge = Callable[[str], str]
Factory = Callable[[], Judge]
#: Functions that one question may hold; larger sets aren't asked about.
WHOLE_SET = 20


def numbered(functions: list[tuple[str, str, str]]) -> str:
    """(name, file, code) of functions, numbered, their code indented."""
    said = []
    for k, (name, file, code) in enumerate(functions, 1):
        said += [f"{k}. Function: {name}", f"   File: {file}", "   Code:", *[f"   {line}" for line in code.split("\n")], ""]
    return "\n".join(said)


def whole_prompt(functions: list[tuple[str, str, str]]) -> str:
    return "TASK pairs\nWhich of these functions do the same?  Answer as JSON: duplicate_pairs, a list of function1_name, function2_name, similarity_score, reasoning.\n" + numbered(functions)


def pair_prompt(a: tuple[str, str], b: tuple[str, str]) -> str:
    return "TASK compare\nDo these two functions do the same?  Answer as JSON: similar, similarity_score, reasoning.\n" + numbered([(*a[:1], "", a[1]), (*b[:1], "", b[1])])


def split_prompt(functions: list[tuple[str, str]]) -> str:
    return "TASK split\nGive a regular expression that parts these functions in two by their code.  Answer as JSON: pattern, reasoning, group_a_name, group_b_name.\n" + numbered([(n, "", c) for n, c in functions])


def intent_prompt(code: str) -> str:
    return "TASK intent\nSay in one sentence what this code is for.\n" + code


def parsed(response: str) -> dict:
    """The JSON object between the outermost braces; an error if there is none."""
    found = re.search(r"\{.*\}", response, re.DOTALL)
    value = json.loads(found.group() if found else response)
    if not isinstance(value, dict):
        raise ValueError("the response is no JSON object")
    return value


_ITEM = re.compile(r"^\d+\. Function: (.*)\n   File: .*\n   Code:\n((?:   .*\n?)*)", re.MULTILINE)


def _items(prompt: str) -> list[tuple[str, str]]:
    return [(n, "\n".join(x[3:] for x in c.rstrip("\n").split("\n"))) for n, c in _ITEM.findall(prompt)]


def _words(code: str) -> set[str]:
    return set(re.findall(r"[a-z]+", code.lower()))


def _share(one: set[str], two: set[str]) -> float:
    return len(one & two) / len(one | two) if one | two else 1.0


def rule_judge() -> Judge:
    """Functions are alike as far as the words of their code are; splits by the word nearest to half of them."""

    def answer(prompt: str) -> str:
        task = prompt.split("\n", 1)[0].removeprefix("TASK ")
        if task == "intent":
            return " ".join(sorted(_words(prompt.split("\n", 2)[2])))
        items = _items(prompt)
        bags = [_words(c) for _, c in items]
        if task == "pairs":
            pairs = [(i, j, _share(bags[i], bags[j])) for i in range(len(items)) for j in range(i + 1, len(items))]
            return json.dumps({"duplicate_pairs": [{"function1_name": items[i][0], "function2_name": items[j][0], "similarity_score": s, "reasoning": "common words"} for i, j, s in pairs if s >= 0.5]})
        if task == "compare":
            s = _share(*bags)
            return json.dumps({"similar": s >= 0.5, "similarity_score": s, "reasoning": "common words"})
        every = sorted(set().union(*bags)) if bags else []
        far = {w: abs(2 * sum(w in b for b in bags) - len(bags)) for w in every}
        best = min(every, key=lambda w: (far[w], w), default="")
        return json.dumps({"pattern": rf"\b{best}\b", "reasoning": "splits evenly", "group_a_name": f"with {best}", "group_b_name": f"without {best}"})

    return answer


def prompt_key(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


@dataclass(frozen=True)
class Recorded:
    """A factory of judges that answer from a record of bounded size (key of the prompt, response)."""

    answers: dict[str, str]

    def __call__(self) -> Judge:
        def answer(prompt: str) -> str:
            return self.answers[prompt_key(prompt)]

        return answer


def recorded_judge(answers: DataFrame, most: int = 100_000) -> Recorded:
    """From a table (key, response); more than `most` rows are an error."""
    rows = answers.select("key", "response").limit(most + 1).collect()
    if len(rows) > most:
        raise ConfigurationError(f"a record of more than {most} answers isn't shipped to executors")
    return Recorded({r["key"]: r["response"] for r in rows})


#: Judges by the name that the environment gives.
PROVIDERS: dict[str, Factory] = {"rules": rule_judge}


def from_environment(variable: str = "CINNABAR_JUDGE") -> Factory:
    """The factory that the environment names; an error if it names none that is known."""
    name = os.environ.get(variable)
    if not name or name not in PROVIDERS:
        raise ConfigurationError(f"{variable} must name a judge: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


class Limiter:
    """Requests a second, adapted: more after 10 successes in a row, less after a failure."""

    def __init__(self, rate: float = 10.0, least: float = 1.0, most: float = 50.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.first, self.rate, self.least, self.most, self.clock, self.sleep = rate, rate, least, most, clock, sleep
        self.good = self.bad = 0
        self.last = float("-inf")

    def acquire(self) -> None:
        wait = self.last + 1 / self.rate - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.last = self.clock()

    def success(self) -> None:
        self.good, self.bad = self.good + 1, 0
        if self.good >= 10:
            self.rate, self.good = min(self.rate * 1.2, self.most), 0

    def failure(self, limited: bool = False) -> None:
        self.good, self.bad = 0, self.bad + 1
        if limited or self.bad >= 2:
            self.rate, self.bad = max(self.rate * (0.5 if limited else 0.8), self.least), 0

    def reset(self) -> None:
        self.rate, self.good, self.bad = self.first, 0, 0


@dataclass(frozen=True)
class Batches:
    """How many items to ask about at a time."""

    least: int = 10
    most: int = 100
    tokens: int = 8000

    def size(self, free_mb: float, item_tokens: int = 100) -> int:
        """By 30 % of the free memory (4 bytes a token and 1,000 an item), and by the tokens of a batch."""
        memory = int(free_mb * 0.3 / ((item_tokens * 4 + 1000) / 2**20))
        return min(self.most, max(self.least, min(memory, self.tokens // item_tokens)))

    def adapted(self, now: int, success: float, seconds: float) -> int:
        """The next size after a batch with this share of successes and this time."""
        if success < 0.8 or seconds > 30:
            return max(self.least, int(now * (0.8 if success < 0.8 else 0.9)))
        return min(self.most, int(now * 1.2)) if success > 0.95 and seconds < 10 else now


def limited(factory: Factory, rate: float = 10.0) -> Factory:
    """A factory whose judges keep to a Limiter, one for each task; cap tasks to cap the whole rate."""

    def made() -> Judge:
        judge, limiter = factory(), Limiter(rate)

        def answer(prompt: str) -> str:
            limiter.acquire()
            try:
                said = judge(prompt)
            except Exception as e:
                limiter.failure("rate limit" in str(e).lower())
                raise
            limiter.success()
            return said

        return answer

    return made


def retry(f: Callable, attempts: int = 3, factor: float = 1.5, sleep: Callable[[float], None] = time.sleep, on: type[Exception] = OSError) -> Callable:
    """f, tried again after factor^attempt seconds when it fails with an error of this kind."""

    def tried(*args, **named):
        for k in range(attempts):
            try:
                return f(*args, **named)
            except on:
                if k == attempts - 1:
                    raise
                sleep(factor**k)

    return tried


def _known(records: DataFrame) -> DataFrame:
    return records.where((F.length("code_content") > 0) & (F.length("function_name") > 0))


def whole_set(records: DataFrame, factory: Factory, threshold: float = 0.7, most: int = WHOLE_SET) -> DataFrame:
    """(id_a, id_b, similarity_score, reasoning): one question about all records; none if they are fewer than 2 or more than `most`.

    Of records with one name the last by id answers for it.
    """
    schema = "id_a long, id_b long, similarity_score double, reasoning string"
    spark = records.sparkSession
    rows = _known(records).select("id", "function_name", F.coalesce("file_path", F.lit("unknown")).alias("file"), "code_content").limit(most + 1).collect()
    if not 2 <= len(rows) <= most:
        return spark.createDataFrame([], schema)
    rows.sort(key=lambda r: r["id"])
    by_name = {r["function_name"]: r["id"] for r in rows}
    said = parsed(factory()(whole_prompt([(r["function_name"], r["file"], r["code_content"]) for r in rows])))
    out = []
    for p in said.get("duplicate_pairs", []):
        a, b, s = by_name.get(p.get("function1_name")), by_name.get(p.get("function2_name")), float(p.get("similarity_score", 0.0))
        if a is not None and b is not None and s >= threshold:
            out.append((a, b, s, p.get("reasoning", "judged a duplicate")))
    return spark.createDataFrame(out, schema)


def converted(pairs: DataFrame, records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Answers (function1_name, function2_name, similarity_score, reasoning) as pairs of records: of each name the last by id."""
    last = _known(records).groupBy("function_name").agg(F.max("id").alias("id"))
    one, two = last.select(F.col("function_name").alias("function1_name"), F.col("id").alias("id_a")), last.select(F.col("function_name").alias("function2_name"), F.col("id").alias("id_b"))
    return pairs.where(F.col("similarity_score") >= threshold).join(one, "function1_name").join(two, "function2_name").select("id_a", "id_b", "similarity_score", "reasoning")


def group_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b, name_a, name_b, code_a, code_b): all pairs of records of one analysis key, each text pair once.

    Records with the same name and code are asked about once, for the smallest id.  The judge is asked about every pair of
    a group, as its answer can't be told from anything else; keep groups small.
    """
    side = _known(records).groupBy(F.col("function_name").alias("name"), F.col("code_content").alias("code")).agg(F.min("id").alias("id")).withColumn("key", X.analysis_key(F.col("name")))
    a, b = side.alias("a"), side.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    return met.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("id", "name", "code") for s in ("a", "b")])


def compare_pairs(pairs: DataFrame, factory: Factory, threshold: float = 0.7) -> DataFrame:
    """(id_a, id_b, similarity_score, reasoning) of the pairs that the judge finds similar enough; failures aren't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = factory()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    said = parsed(judge(pair_prompt((r.name_a, r.code_a), (r.name_b, r.code_b))))
                    out.append((r.id_a, r.id_b, bool(said.get("similar", False)), float(said.get("similarity_score", 0.0)), said.get("reasoning", "none given")))
                except Exception as e:  # noqa: BLE001
                    out.append((r.id_a, r.id_b, False, 0.0, f"failed: {e}"))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "similar", "similarity_score", "reasoning"])

    judged = pairs.mapInPandas(run, "id_a long, id_b long, similar boolean, similarity_score double, reasoning string")
    return judged.where(F.col("similar") & (F.col("similarity_score") >= threshold)).drop("similar")


def pairwise(records: DataFrame, factory: Factory, threshold: float = 0.7) -> DataFrame:
    """The pairwise detector: pairs of one analysis key that the judge finds similar."""
    return compare_pairs(group_pairs(records), factory, threshold)


def semantic(candidates: DataFrame, factory: Factory, most: int | None = 20, duplicate: float = 0.8) -> DataFrame:
    """Candidates (id_a, id_b, code_a, code_b, similarity_score) by what the judge says the codes are for, the likest first.

    Adds intent_a, intent_b, semantic_similarity, is_duplicate and explanation; the first `most` by score are asked about.
    """
    chosen = candidates.orderBy(F.desc("similarity_score"), "id_a", "id_b").limit(most) if most is not None else candidates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = factory()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    out.append((r.id_a, r.id_b, r.similarity_score, judge(intent_prompt(r.a)) or "Unknown intent", judge(intent_prompt(r.b)) or "Unknown intent"))
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.DataFrame(out, columns=["id_a", "id_b", "similarity_score", "intent_a", "intent_b"])

    said = chosen.select("id_a", "id_b", "similarity_score", dedent("code_a").alias("a"), dedent("code_b").alias("b")).mapInPandas(run, "id_a long, id_b long, similarity_score double, intent_a string, intent_b string")
    likeness = X.intent_likeness(F.col("intent_a"), F.col("intent_b"))
    same = F.col("semantic_similarity") >= duplicate
    explained = F.when(same, F.concat(F.lit("the same purpose: "), "intent_a")).otherwise(F.concat_ws("", F.lit("different purposes: "), "intent_a", F.lit(" against "), "intent_b"))
    return said.withColumn("semantic_similarity", F.round(likeness, 6)).withColumn("is_duplicate", same).withColumn("explanation", explained).orderBy(F.desc("semantic_similarity"), "id_a", "id_b")


def split_pattern(samples: list[tuple[str, str]], factory: Factory) -> tuple[str, str, str, str]:
    """(pattern, reasoning, name of those that match, name of the others) for sample functions (name, code)."""
    said = parsed(factory()(split_prompt(samples)))
    return said.get("pattern", ""), said.get("reasoning", "parts the functions in two"), said.get("group_a_name", "Group A"), said.get("group_b_name", "Group B")


def split_rules(samples: list[tuple[str, str]], factory: Factory, most: int = 3) -> list[tuple[str, str]]:
    """Up to `most` distinct (pattern, reasoning) in twice as many tries; tries that fail are passed over."""
    rules: dict[str, str] = {}
    for _ in range(2 * most):
        if len(rules) >= most:
            break
        try:
            pattern, reasoning, _, _ = split_pattern(samples, factory)
        except Exception:  # noqa: BLE001, S112
            continue
        number = len(rules) + 1
        rules.setdefault(pattern, f"Rule {number}: {reasoning}")
    return list(rules.items())


def sample(members: DataFrame, group: str, n: int = 5, seed: int = 0) -> list[tuple[str, str]]:
    """n functions (name, code) of a group, by a hash."""
    rows = members.where(F.col("group_id") == group).orderBy(F.xxhash64("name", "code", F.lit(seed)), "name", "code").limit(n).select("name", F.coalesce("code", F.lit("")).alias("code")).collect()
    return [(r["name"], r["code"]) for r in rows]


def rules_for_large_groups(functions: DataFrame, factory: Factory, threshold: int = 20, most: int = 3, samples: int = 50, least: int = 5) -> DataFrame:
    """(file, pattern, reasoning): rules for the files of more than `threshold` functions, from a bounded sample of each.

    functions: file, name, code; code is cut to 500 characters.  Each file's sample is asked about where it lies.
    """
    known = functions.where((F.length("code") > 0) & (F.length("name") > 0)).select("file", "name", X.cut(F.col("code")).alias("code"))
    large = functions.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold).select("file")
    order = Window.partitionBy("file").orderBy(F.xxhash64("name", "code"), "name", "code")
    chosen = known.join(large, "file", "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        got = split_rules(list(zip(rows["name"], rows["code"], strict=True)), factory, most) if len(rows) >= least else []
        return pd.DataFrame([(rows["file"].iloc[0], p, r) for p, r in got], columns=["file", "pattern", "reasoning"])

    return chosen.groupBy("file").applyInPandas(run, "file string, pattern string, reasoning string")


def involving(pairs: DataFrame, record: int) -> tuple[DataFrame, Column]:
    """The pairs that a record is in, and their greatest similarity as a column to aggregate."""
    return pairs.where((F.col("id_a") == record) | (F.col("id_b") == record)), F.coalesce(F.max("similarity_score"), F.lit(0.0))


def unsplittable(group: str, attempts: int) -> AnalysisError:
    return AnalysisError(f"group {group} can't be split after {attempts} attempts")


def intent_tree_status() -> dict[str, object]:
    """Of the optional explorer of intents, its sessions and learning statistics: there is no backend for it."""
    return {"available": False, "sessions": 0, "features": 0, "message": "unavailable"}
