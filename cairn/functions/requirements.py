"""Free-text travel wishes: conditions by keyword, and negation within the clause (F24, F25, PF27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.vocab import KEYWORDS

# What a wish may say, in order of precedence; what negates it; where a clause ends.
COMPANIONS = [("parents", "부모님|부모|어르신"), ("kids", "아이|애기|자녀"), ("couple", "연인|커플"), ("friends", "친구"), ("solo", "혼자|홀로")]
WALKS = [("low", r"걷\S*\s*(적게|싫|힘들)|적게\s*걷|걷기\s*힘들|도보\s*적게"), ("moderate", r"걷기\s*보통|적당히\s*걷")]
PRIORITIES = [("sea", "바다|바닷"), ("food", "맛집|음식|먹거리"), ("photo", "사진|포토"), ("culture", "문화|역사"), ("rest", "휴식|쉬고|힐링"), ("quiet", "조용|한적")]
AVOIDS = [("waiting", r"대기|웨이팅|줄\s*서"), ("stairs", "계단"), ("noise", "시끄|소음"), ("parking", "주차"), ("crowd", "붐비|혼잡|인파")]
PLACES = [("restaurant", "식당|음식점|맛집"), ("hotel", "호텔|숙소|숙박"), ("attraction", "관광지|명소")]
NEGATION = r"필요\s?(?:가\s?)?(?:없|하지\s?않)|상관\s?없|관심\s?없|신경\s?(?:안|쓰지\s?않)|중요하지\s?않|안\s?\S*도\s?(?:돼|되|괜찮)|(?:없어|빼)도\s?(?:돼|되|괜찮)"
CLAUSE_END = r"[.!?,\n]|고\s|는데|지만|면서"


def conditions(text: Column) -> Column:
    """struct<with, walk, pri, avoid, category> of a wish; of companions, walks and categories the first counts."""
    one = lambda rules: F.coalesce(*[F.when(text.rlike(f"(?U){p}"), F.lit(v)) for v, p in rules])
    many = lambda rules: F.array_compact(F.array(*[F.when(text.rlike(f"(?U){p}"), F.lit(v)) for v, p in rules]))
    return F.struct(one(COMPANIONS).alias("with"), one(WALKS).alias("walk"), many(PRIORITIES).alias("pri"), many(AVOIDS).alias("avoid"), one(PLACES).alias("category"))


def keyword_state(text: Column, pattern: str) -> Column:
    """Whether a wish names a keyword: null if not, true if it only says that it does not matter, false otherwise.

    Every mention counts with the rest of its clause, from its end to the first end of a clause that stops behind it: such
    a piece without a negation makes the keyword wanted.
    """
    rests = F.slice(F.split(text, f"(?U){pattern}", -1), 2, 1_000_000_000)  # what follows each mention, up to the next one
    count = F.size(rests)
    # the clause of a mention may hold later mentions: put the text behind each together again
    matches = F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), F.lit(1))
    behind = F.transform(F.sequence(F.lit(1), count), lambda k: F.concat(F.get(rests, k - 1), F.array_join(F.transform(F.when(k < count, F.sequence(k, count - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(F.get(matches, j), F.get(rests, j))), "")))
    last = lambda k: F.right(F.get(matches, k), F.lit(1))  # noqa: E731  an end of a clause may begin in the mention's last letter
    pieces = F.transform(behind, lambda rest, k: F.concat(last(k), rest))
    clause = lambda x: F.regexp_extract(F.substring(x, F.lit(2), F.length(x)), f"(?sU)^(.*?(?:{CLAUSE_END}|$))", 1)
    negated = lambda x: ~x.rlike("(?U)^(?:고\\s|는데|지만|면서)") & clause(x).rlike(f"(?U){NEGATION}")
    return F.when(count > 0, F.forall(pieces, negated))


def keyword_states(text: Column, only: list[str] | None = None) -> Column:
    """array<struct<keyword, negated>> of the keywords that a wish names, in their order."""
    some = [(k, pattern) for k, (pattern, _) in KEYWORDS.items() if only is None or k in only]
    states = [F.struct(F.lit(k).alias("keyword"), keyword_state(text, pattern).alias("negated")) for k, pattern in some]
    return F.filter(F.array(*states), lambda s: s.getField("negated").isNotNull())


def wish_weights(wishes: DataFrame, key: str, text: str, only: list[str] | None = None) -> DataFrame:
    """key, aspect, weight, keywords: what each wish asks for; weights of its keywords add up, those that do not matter are out."""
    pairs = [F.struct(F.lit(k).alias("keyword"), F.lit(i).alias("rank"), F.lit(a).alias("aspect"), F.lit(float(w)).alias("weight")) for i, (k, (_, weights)) in enumerate(KEYWORDS.items()) for a, w in weights.items()]
    states = wishes.select(key, F.explode(keyword_states(F.col(text), only)).alias("s")).where("not s.negated").select(key, "s.keyword")
    table = F.broadcast(wishes.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*"))  # the fixed keywords
    met = states.join(table, "keyword").groupBy(key, "aspect").agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("k"))  # keywords of one wish
    return met.select(key, "aspect", "weight", F.transform("k", lambda x: x.getField("keyword")).alias("keywords"))


def ignored_keywords(text: Column) -> Column:
    """Keywords that a wish says do not matter."""
    return F.transform(F.filter(keyword_states(text), lambda s: s.getField("negated")), lambda s: s.getField("keyword"))


def csv_values(c: Column, allowed: list[str]) -> tuple[Column, Column]:
    """Values of a comma list, each once in order, and those that are not allowed."""
    values = F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return values, F.array_except(values, F.array(*map(F.lit, allowed)))
