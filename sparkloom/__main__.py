"""``python -m sparkloom --version``."""

import argparse

from . import __version__

parser = argparse.ArgumentParser(prog="sparkloom")
parser.add_argument("--version", action="version", version=f"sparkloom {__version__}")

if __name__ == "__main__":
    parser.parse_args()
    parser.print_help()
