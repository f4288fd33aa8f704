"""Words of the gate that name no document, and what its results depend on (A-GA2, A-GA11).

``reading`` reads questions in a plan and ``planning.decide`` is the cascade.
"""

from __future__ import annotations

import re

from lithic.operators.planning import JURISDICTIONS

#: Words that describe a kind of document and name none.
DESCRIPTORS = (
    "guidance guidelines guideline supervisory supervision regulator regulators regulation regulations regulatory rule rules rulebook requirement requirements standard standards framework "
    "frameworks guide handbook letter letters circular circulars policy policies statement statements principle principles document documents paper papers consultation directive act law laws "
    "code manual bulletin notice expectation expectations text texts version versions earlier previous prior current the a an of for on and or"
).split()


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def generic_tokens() -> set[str]:
    """Descriptors and every word that names a jurisdiction or regulator (A-GA2)."""
    return set(DESCRIPTORS) | {t for terms in JURISDICTIONS.values() for term in terms for t in words(term)}


def config_text(**settings) -> str:
    """What a result depends on besides its question, as one string (A-GA11, A-GE14)."""
    return "|".join(f"{k}={settings[k]}" for k in sorted(settings))
