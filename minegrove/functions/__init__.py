from .ids import clean_id
from .skew import hot_keys, salted_join

__all__ = ["clean_id", "hot_keys", "salted_join"]
