"""Engine parameters, from Python or an INI file."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace

#: English words without content of their own; any list can take their place.
STOPWORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "did", "do", "for",
    "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not",
    "of", "on", "or", "our", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were",
    "what", "when", "which", "who", "will", "with", "you", "your",
)


def str_to_bool(value: str) -> bool:
    return value.lower() in ("yes", "true", "t", "1")


@dataclass(frozen=True)
class EngineConfig:
    item_limit: int | None = None  #: items read from a dump, redirects included; None: all
    idf_total: int | None = None  #: numerator of the inverse document frequency; None: the number of documents
    tf_denominator: str = "compat"  #: compat (all words and once more those that are no stop words), total or nonstop
    tf_digits: int = 5  #: digits that term frequencies are cut to
    similarity_digits: int = 3  #: digits that similarities are cut to
    stopwords: tuple[str, ...] = field(default=STOPWORDS)
    centers: int = 10
    iterations: int = 5
    least_shift: float = 0.1  #: a new center's similarity must differ from its cluster's average by more
    k: int = 10  #: neighbours
    svm_c: float = 1.0
    kernel: str = "linear"
    seed: int = 42
    load_from_db: bool = False
    save_to_db: bool = False
    warehouse: str = ""

    @classmethod
    def from_ini(cls, path: str) -> EngineConfig:
        """Options of all sections; [a,b] is a list."""
        parser = configparser.ConfigParser()
        with open(path) as f:
            parser.read_file(f)
        found, kinds = {}, {f.name: f for f in fields(cls)}
        for section in parser.sections():
            for key, text in parser.items(section):
                if key in kinds:
                    found[key] = _parsed(text, kinds[key].default, str(kinds[key].type))
        return replace(cls(), **found)


def _parsed(text: str, default, kind: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return tuple(x.strip() for x in text[1:-1].split(",") if x.strip())
    if isinstance(default, bool):
        return str_to_bool(text)
    if "int" in kind:
        return None if "None" in kind and text.lower() in ("", "none") else int(text)
    return float(text) if kind == "float" else text
