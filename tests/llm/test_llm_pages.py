"""Main text of pages of layouts that the labeller's training never draws, and of pages without landmarks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerlark.llm import block_lstm, block_lstm_train
from ledgerlark.llm.html_blocks import blocks

MAIN, OTHER = block_lstm_train.MAIN, block_lstm_train.OTHER


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(block_lstm_train.SYLLABLES, k=r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def prose(r: random.Random) -> str:
    return " ".join(sentence(r, r.randint(6, 20)) for _ in range(r.randint(1, 4)))


PLAIN = {
    "two paragraphs": lambda p: f"<p>{p()}</p><p>{p()}</p>",
    "one paragraph": lambda p: f"<p>{p()}</p>",
    "button inside": lambda p: f"<p>{p()} <button>More</button> {p()}</p><p>{p()}</p>",
    "short divs": lambda p: f"<div><div>{p()}</div><div>{p()}</div></div>",
    "section": lambda p: '<section class="post-body">' + "".join(f"<p>{p()}</p>" for _ in range(12)) + "</section>",
    "twelve paragraphs": lambda p: "".join(f"<p>{p()}</p>" for _ in range(12)),
    "twelve divs": lambda p: "<div>" + "".join(f"<div>{p()}</div>" for _ in range(12)) + "</div>",
}


@pytest.mark.parametrize("kind", PLAIN)
def test_pages_without_landmarks_are_whole(kind):
    for seed in range(5):
        r = random.Random(seed)
        found = blocks(f"<!DOCTYPE html><html><head><title>x</title></head><body>{PLAIN[kind](lambda r=r: prose(r))}</body></html>")
        assert (block_lstm.label([found])[0] >= block_lstm.KEEP).all()


def unseen(seed: int) -> str:
    """A layout of tables and fonts, definition lists, spans, figures, quotations or headings with boxes."""
    r = random.Random(seed)
    texts = [MAIN + prose(r) for _ in range(r.choice((2, 4, 9)))]
    menu = " | ".join(f'<a href="/{k}">{OTHER}{sentence(r, 1)[:-1]}</a>' for k in range(5))
    foot = f"<p>{OTHER}Copyright 2021 {sentence(r, 2)}</p>"
    body = (
        f"<center><table><tr><td>{menu}</td></tr><tr><td><font size=2>{'<br><br>'.join(texts)}</font></td></tr></table></center>{foot}",
        f"<div id=q7><div>{menu}</div><dl>{''.join(f'<dd>{x}</dd>' for x in texts)}</dl></div>{foot}",
        f"<main><div class=zz9>{''.join(f'<div class=k{i}><span>{x}</span></div>' for i, x in enumerate(texts))}</div></main><footer>{OTHER}Imprint</footer>",
        f"<nav>{menu}</nav><figure><figcaption>{texts[0]}</figcaption></figure>{''.join(f'<p class=lead>{x}</p>' for x in texts[1:])}<footer>{foot}</footer>",
        f"<section><section>{''.join(f'<blockquote><p>{x}</p></blockquote>' for x in texts)}</section></section><aside>{menu}</aside>",
        f"<div role=main>{''.join(f'<h2>{MAIN}{sentence(r, 4)[:-1]}</h2><div><p>{x}</p></div>' for x in texts)}</div><div class=ad>{OTHER}{sentence(r, 9)}</div>",
    )[seed % 6]
    return f"<html><body>{body}</body></html>"


def test_layouts_that_training_never_draws():
    """Over 98 % of the characters are judged right."""
    right = total = 0
    for seed in range(300):
        found = blocks(unseen(seed))
        truth = np.array([b.text.count(MAIN) > b.text.count(OTHER) for b in found])
        for b in found:
            b.text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split()) or "|"
        size = np.array([len(b.text) for b in found])
        said = block_lstm.label([found])[0] >= block_lstm.KEEP
        right, total = right + size[said == truth].sum(), total + size.sum()
    assert right > 0.98 * total
