from __future__ import annotations

import sys

from stemma.engine import main

main(sys.argv[1:])
