"""Column expressions used by the operators (no Python UDFs)."""

from .classify import (account_from_emails, account_from_title, account_risk, call_type,
                       deadline_label, fixed_round, ordered_rank, resolve_account, risk_tier,
                       route_question, sentiment_band, six_places, speaker_role, split_owner_task,
                       toggle_status)
from .text import (contains_any, contains_word, display_name, domain_label, first_match,
                   iso_to_timestamp, label_with_ellipsis, local_part, py_float_text, py_text,
                   python_title, strip_ws, whole_word_pattern)

__all__ = [n for n in dir() if not n.startswith("_")]
