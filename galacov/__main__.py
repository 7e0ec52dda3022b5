import sys

from galacov.plans.command import main

main(sys.argv[1:])
