"""The stand-in scorer: word lists counted with native expressions.

It only stands where a model would be called, so that labelling jobs run
without a network. It makes no claim to agree with any model.
"""

from dataclasses import dataclass, field

from pyspark.sql import functions as F


@dataclass(frozen=True)
class WordLists:
    """Lower-case ASCII words that decide the labels of a text."""

    positive: tuple = (
        "amazing", "best", "better", "clear", "easy", "excellent", "fast", "good",
        "great", "helpful", "love", "nice", "perfect", "reliable", "smooth", "useful",
    )
    negative: tuple = (
        "bad", "broken", "bug", "confusing", "crash", "down", "error", "expensive",
        "fail", "failed", "hate", "lost", "missing", "poor", "problem", "slow", "wrong",
    )
    critical: tuple = ("crash", "down", "lost", "outage")
    high: tuple = ("broken", "error", "fail", "failed", "urgent")
    themes: dict = field(
        default_factory=lambda: {
            "performance": ("fast", "latency", "performance", "slow", "speed"),
            "pricing": ("bill", "cost", "expensive", "price", "pricing"),
            "documentation": ("docs", "documentation", "example", "guide", "tutorial"),
            "developer-experience": ("api", "cli", "code", "debug", "sdk"),
            "reliability": ("crash", "down", "error", "fail", "outage"),
            "feature-request": ("add", "feature", "request", "support", "wish"),
        }
    )

    def all_words(self):
        groups = [self.positive, self.negative, self.critical, self.high]
        groups += self.themes.values()
        return sorted({word for group in groups for word in group})


def listed_words(text, lists):
    """Every listed word in the whole text, in any case, as a lower-case array."""
    pattern = "(?i)(?<![a-z])(?:" + "|".join(lists.all_words()) + ")(?![a-z])"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def hits(found, words):
    return F.array_size(F.filter(found, lambda word: word.isin(*words)))


def balance(positive, negative):
    """(positive - negative) / (positive + negative) in -1..1; 0 without a hit."""
    total = positive + negative
    return F.when(total > 0, (positive - negative) / total).otherwise(0.0)


def sentiment_of(score):
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def theme_of(counts):
    """The theme with most hits, the first named on a tie, ``other`` without a hit.

    ``counts`` maps each theme name to its column of hits.
    """
    most = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    chosen = F.when(most == 0, "other")
    for theme, number in counts.items():
        chosen = chosen.when(number == most, theme)
    return chosen


def urgency_of(critical, high, score):
    return (
        F.when(critical > 0, "critical")
        .when(high > 0, "high")
        .when(score < 0, "medium")
        .otherwise("low")
    )
