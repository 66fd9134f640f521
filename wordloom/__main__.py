"""``python -m wordloom PROGRAM SOURCE OUT [options]``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .plans import programs as P


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wordloom")
    sub = top.add_subparsers(dest="program", required=True)

    def add(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("out")
        for flags, settings in options:
            p.add_argument(*flags, **settings)

    number = lambda *flags, kind=int, dest: (flags, {"type": kind, "dest": dest, "default": None})
    switch = lambda *flags, dest: (flags, {"action": "store_true", "dest": dest})
    v, s = number("-v", "--vocabulary", dest="vocabulary"), number("-s", "--threshold", kind=float, dest="threshold")
    training = (v, s, number("-e", "--dim", dest="dim"), number("-n", "--negatives", dest="negatives"), number("-c", "--context", dest="context"), number("-k", "--kappa", kind=float, dest="kappa"))
    parity = switch("--parity", dest="parity")
    add("naive-lm-train", v, s, parity)
    add("naive-lm-print", switch("-c", "--counts", dest="counts"))
    add("spacesaving-lm-train", v, s, switch("--merged", dest="merged"), parity)
    add("spacesaving-lm-print", switch("-c", "--counts", dest="counts"))
    add("word2vec-vocab-to-naive-lm", s)
    for name in ("word2vec-train", "word2vec-alias-train"):
        add(name, *training, (("-l", "--lm"), {"dest": "lm", "default": None}), switch("--exact", dest="exact"), number("--epochs", dest="epochs"), parity)
    add("spacesaving-word2vec-train", *training, number("-t", "--tau", kind=float, dest="tau"), number("-r", "--reservoir", dest="reservoir"))
    for name in ("word2vec-print", "word2vec-alias-print", "spacesaving-word2vec-print"):
        add(name, switch("-w", "--words", dest="words"), switch("-d", "--dims", dest="dims"))
    return top


PROGRAMS = {
    "naive-lm-train": P.naive_lm_train, "naive-lm-print": P.lm_print, "spacesaving-lm-train": P.spacesaving_lm_train, "spacesaving-lm-print": P.lm_print,
    "word2vec-vocab-to-naive-lm": P.vocab_to_naive_lm, "word2vec-train": P.word2vec_train, "word2vec-alias-train": P.word2vec_train,
    "spacesaving-word2vec-train": P.spacesaving_word2vec_train, "word2vec-print": P.word2vec_print, "word2vec-alias-print": P.word2vec_print, "spacesaving-word2vec-print": P.word2vec_print,
}


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    a = {k: v for k, v in vars(parser().parse_args(args)).items() if v is not None}
    name = a.pop("program")
    if name == "word2vec-alias-train":
        a["noise"] = "alias"
    PROGRAMS[name](SparkSession.builder.appName(f"wordloom {name}").getOrCreate(), a.pop("source"), a.pop("out"), **a)


if __name__ == "__main__":
    main()
