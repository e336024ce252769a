"""python -m varispan kmers|conserved|variants ..."""

from .cli import main

main()
