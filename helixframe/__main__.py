"""python -m helixframe"""

from helixframe.cli import main

main()
