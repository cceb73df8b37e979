from . import ngrams, rules, text

__all__ = ["ngrams", "rules", "text"]
