"""Sizes of the three parts of an amplicon from any sufficient set of options."""

from __future__ import annotations


def amplicon_sizes(amplicon=None, diagnostic=None, conserved=None, left=None, right=None) -> tuple[int, int, int]:
    """(left, diagnostic, right). Amplicon and diagnostic together rule the rest: both ends are half of what is left, and an odd base joins the diagnostic part."""
    if amplicon is not None and diagnostic is not None:
        side = (amplicon - diagnostic) // 2
        left = right = side
        diagnostic = amplicon - 2 * side
    elif amplicon is not None and conserved is not None:
        left = right = conserved
        diagnostic = amplicon - 2 * conserved
    elif amplicon is not None and left is not None and right is not None:
        diagnostic = amplicon - left - right
    elif diagnostic is not None and conserved is not None:
        left = right = conserved
    elif diagnostic is None or left is None or right is None:
        raise ValueError("give two of amplicon, diagnostic and conserved sizes, or both conserved sides and one more")
    if min(left, diagnostic, right) < 0 or left + diagnostic + right < 1:
        raise ValueError(f"sizes {left}, {diagnostic}, {right} do not make an amplicon")
    return left, diagnostic, right
