"""Train the block labeller on generated pages: python -m ledgerlark.llm.block_lstm_train

Pages are drawn from many layouts, with semantic tags, with telling class names and with neither, long and of one paragraph, with and without anything
that holds the main text or a title over it. Every piece of
text starts with a private mark that says whether it is main text; the mark goes before the
network sees the block.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from ledgerlark.llm import block_lstm as M
from ledgerlark.llm.html_blocks import Block, blocks

MAIN, OTHER = "", ""

#: Class and id names of page parts, and phrases that stand in them.
NAMES = {
    "menu": "nav menu navbar navigation main-menu topnav site-nav primary-menu menu-bar tabs subnav links".split(),
    "header": "header site-header top masthead page-header banner-top logo branding topbar tagline".split(),
    "footer": "footer site-footer bottom page-footer colophon foot copyright legal credits".split(),
    "side": "sidebar side aside widget widgets right-column left-column rail secondary related-posts recent popular trending archive tag-cloud related recommended more-stories read-next".split(),
    "notice": "notice cookie cookie-banner cookies consent gdpr alert notification banner popup modal overlay message-bar privacy-notice".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion ad-slot adbox banner-ad sponsor commercial google-ads dfp partner".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form register".split(),
    "comment": "comments comment comment-list commentlist replies responses discussion disqus thread reader-comments user-comments reply comment-body".split(),
    "share": "share social social-share sharing follow share-bar buttons breadcrumb breadcrumbs pagination pager prev-next tags meta-links toolbar".split(),
    "main": "content article post entry entry-content post-content article-body story main-content text body-text post-body prose article-content article-text page-content storybody".split(),
    "plain": "wrap wrapper container row col inner page box layout section block grid group outer holder area x1 c12 u7 abc lft".split(),
}
PHRASES = {
    "menu": "Home|About us|Contact|Products|News|Sports|Login|Blog|Services|Menu|Careers|Shop|Archive|FAQ|Help",
    "header": "Daily Gazette|The site for all|Skip to content|Welcome|Sign in|Subscribe now|My account",
    "footer": "© 2024 All rights reserved.|Privacy Policy|Terms of Use|Copyright 2023|Imprint|Contact us|Powered by Wordpress|Sitemap|&copy; example.com &middot;",
    "side": "Recent posts|Popular|Related articles|You may also like|Categories|Archives|Tags|Most read|Read more|See also|Trending now",
    "notice": "This site uses cookies.|We use cookies to improve your experience.|Accept all cookies|I agree|By continuing you accept our policy.|Please enable JavaScript.|You are using an old browser.",
    "ad": "Advertisement|Sponsored|Buy now and save 50%!|Ad|Limited offer|Click here|Special deal today only!|Download our app",
    "form": "Search|Subscribe to our newsletter|Your email|Name|Send|Submit|Enter your email address|Password",
    "comment": "Comments|Leave a reply|Reply|3 comments|says:|Great post, thanks!|I totally agree with this.|Posted by|Report|Log in to comment",
    "share": "Share|Tweet|Facebook|Print|Email this|Home &gt; News|Next|Previous|Page 1 of 3|Tags:",
}
SYLLABLES = "an er in the re th on ed at en es or ti is nd to ha st le de la que ción mente do ar os ie sch ung ch lich ein auf über ver eau tre oi ai ment éa pa ka ro mi su no vel ber gra tor mun lis".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.lexicon = ["".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(150)]
        self.semantic = self.r.random() < 0.6
        self.classes = self.r.random() < 0.8 or not self.semantic and self.r.random() < 0.7
        if self.r.random() < 0.1:  # nothing but div
            self.semantic = self.classes = False
        self.layout = self.r.choices(("usual", "bare", "section", "divs"), (55, 16, 12, 17))[0]
        if self.layout == "divs":
            self.semantic = False
        self.short = self.r.random() < (0.15 if self.layout == "usual" else 0.4)
        self.own_names = self.r.random() < 0.25  # class names that tell nothing
        self.close_p = self.r.random() < 0.75
        self.junk = self.r.random() < 0.2

    def word(self) -> str:
        w = self.r.choice(self.lexicon)
        return w + self.r.choice(("%%%", "***", "$$$", "&amp;&amp;&amp;", "###", "!!")) if self.junk else w

    def sentence(self, low: int = 3, high: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, self.r.randint(1, most)))))

    def name(self, kind: str) -> str:
        if not self.classes and kind != "plain" or self.r.random() < 0.07:
            return ""
        n = self.r.choice(NAMES[kind])
        if self.own_names and kind in ("plain", "main"):
            n = self.r.choice((self.r.choice(self.lexicon), f"{self.r.choice(SYLLABLES)}{self.r.randint(0, 99)}", f"{self.r.choice(self.lexicon)}__{self.r.choice(self.lexicon)}"))
        if self.r.random() < 0.25:
            n += self.r.choice("-_ ") + self.r.choice(NAMES["plain"])
        return f' {self.r.choice(("class", "class", "id"))}="{n}"'

    def rights(self) -> str:
        """A line that says whose the page is."""
        r = self.r
        years = str(r.randint(1996, 2030))
        who = " ".join(self.word().capitalize() for _ in range(r.randint(1, 3)))
        said = f"{r.choice(('Copyright', '&copy;', '(c)', 'Copyright &copy;', '©'))} {years} {who}"
        return said + r.choice((".", "", ",", " |")) + r.choice((" All rights reserved.", " All rights reserved", "", " Tous droits réservés.", " Alle Rechte vorbehalten.", " Todos los derechos reservados."))

    def hidden(self, p: float) -> str:
        return self.r.choice((" hidden", ' style="display:none"', ' aria-hidden="true"')) if self.r.random() < p else ""

    def part(self, kind: str) -> str:
        """A part that isn't main text."""
        r = self.r

        def say(text: str) -> str:
            return OTHER + text

        def phrase() -> str:
            if kind == "footer" and r.random() < 0.4:
                return self.rights()
            return r.choice(PHRASES[kind].split("|")) if r.random() < 0.6 else self.sentence(1, 14).rstrip(".!?") if r.random() < 0.5 else self.prose(2)

        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comment": "section"}.get(kind, "div") if self.semantic and r.random() < 0.85 else r.choice(("div", "div", "div", "section"))
        named = self.name(kind) if tag in ("div", "section") or r.random() < 0.5 else ""
        if tag in ("div", "section") and not named and kind in ("ad", "notice", "comment"):
            named = f' class="{r.choice(NAMES[kind])}"'
        inside = []
        if kind in ("menu", "share") or kind in ("side", "footer", "header") and r.random() < 0.5:
            if kind == "side":
                inside.append(f"<h3>{say(phrase())}</h3>")
            items = [f'<a href="/{r.randint(1, 999)}">{say(self.word() if r.random() < 0.5 else phrase())}</a>' for _ in range(r.randint(2, 9))]
            inside.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.75 else r.choice(("", " | ", "<br>")).join(f"<span>{x}</span>" if r.random() < 0.3 else x for x in items))
        elif kind == "comment":
            inside.append(f"<h3>{say(phrase())}</h3>" if r.random() < 0.7 else "")
            inner = r.choice(("li", "div", "article"))
            for _ in range(r.randint(1, 6)):
                own = f' class="{r.choice(NAMES["comment"])}"' if r.random() < 0.8 else ""
                inside.append(f"<{inner}{own}><b>{say(self.word())}</b><p>{say(self.prose(3))}</p></{inner}>")
        elif kind == "form" and r.random() < 0.4:
            options = "".join(f"<option>{say(self.word())}</option>" for _ in range(r.randint(1, 5)))
            inside.append(r.choice((f"<select>{options}</select>", f"<label>{say(phrase())}</label><textarea>{say(phrase())}</textarea>")) + f"<button>{say(phrase())}</button>")
        elif kind == "notice" and r.random() < 0.3:
            return f"<noscript>{say(phrase())}</noscript>" if r.random() < 0.6 else f"<noscript><p>{say(phrase())}</p></noscript>"
        elif kind == "form":
            inside.append(f"<label>{say(phrase())}</label><input type=text> <p>{say(phrase())}</p>" if r.random() < 0.7 else f"<p>{say(phrase())}</p><input>")
        elif kind == "footer":
            inside.append(r.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(say(phrase() + (" " + self.prose(2) if r.random() < 0.5 else ""))))
        elif kind == "header":
            inside.append(r.choice(("<h1>{}</h1>", "<div>{}</div>", "<a href='/'>{}</a>", "<p>{}</p>")).format(say(phrase())))
            if r.random() < 0.4:
                inside.append(f"<p>{say(phrase())}</p>")
        else:
            for _ in range(r.choice((1, 1, 2))):
                inside.append(r.choice(("{}", "<p>{}</p>", "<span>{}</span>", "<a href='#'>{}</a>", "<div><button>{}</button></div>")).format(say(phrase())))
        return f"<{tag}{named}{self.hidden(0.06)}>{''.join(inside)}</{tag}>"

    def main(self) -> str:
        r = self.r

        def say(text: str) -> str:
            return MAIN + text

        title = self.sentence(2, 12).rstrip(".!?") if r.random() < 0.6 else self.sentence(2, 18)
        head = f"<h1>{say(title)}</h1>" if r.random() < 0.85 else f"<h2>{say(title)}</h2>"
        if self.semantic and r.random() < 0.15:
            head = f"<header>{head}</header>"
        if self.layout != "usual" and r.random() < 0.5 or self.short and r.random() < 0.3:
            head = "" if r.random() < 0.7 else f"<div>{say(title)}</div>"
        out = [head]
        close = "</p>" if self.close_p else ""
        for k in range(r.choice((1, 1, 2)) if self.short else r.choice((1, 2, 3, 5, 12, r.randint(1, 20)))):
            kind = r.random()
            if kind < 0.78 or self.short:
                text = self.prose()
                if r.random() < 0.12:
                    text = text.replace(" ", ' <a href="/x">', 1).replace(".", "</a>.", 1)
                if r.random() < (0.12 if self.short else 0.05):
                    put = f"<button>{self.word()}</button>" if r.random() < 0.6 else "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>"
                    text = text.replace(" ", f" {put} ", 1)
                if r.random() < 0.04:
                    odd = r.choice(("<noscript><p>{}</p></noscript>", "<p" + self.hidden(1) + ">{}</p>", "<div" + self.hidden(1) + "><p>{}</p></div>", "<p><math><mi>{}</mi></math></p>"))
                    out.append(odd.format(say(text)))
                    continue
                if self.layout == "divs":
                    out.append(r.choice(("<div>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>", "{}<br><br>")).format(say(text)))
                    continue
                out.append(f"<p>{say(text)}{close}" if r.random() < 0.9 else f"<p><b>{say(text)}<br><p>{say(self.prose())}{close}")
            elif kind < 0.86:
                out.append(f"<h{r.choice('23')}>{say(self.sentence(1, 8).rstrip('.!?'))}</h2>" if self.layout != "divs" else f"<div><b>{say(self.sentence(1, 8).rstrip('.!?'))}</b></div>")
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{say(self.sentence(1, 12))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{say(self.prose())}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{say(self.word())}</td><td>{say(self.sentence(1, 6))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f"<div>{say(self.prose())}</div>")
            if k and r.random() < 0.06:
                out.append(self.part(r.choice(("ad", "side", "share", "form", "notice"))))
        inside = "".join(out)
        if self.layout == "bare":
            return inside
        if self.layout == "section":
            return f"<section{self.name('main')}>{inside}</section>"
        if self.layout == "divs":
            return f"<div{self.name('plain') if r.random() < 0.5 else ''}>{inside}</div>" if r.random() < 0.8 else inside
        if self.semantic and r.random() < 0.8:
            inside = f"<article{self.name('main') if r.random() < 0.3 else ''}>{inside}</article>"
        elif self.classes:
            inside = f"<div{self.name('main')}>{inside}</div>"
        else:
            inside = f"<div>{inside}</div>"
        return f"<main>{inside}</main>" if self.semantic and r.random() < 0.3 else inside

    def page(self) -> str:
        r = self.r
        alone = self.layout != "usual" and r.random() < 0.25  # a page with nothing beside its text
        before = [] if alone else [k for k, p in (("notice", 0.2), ("header", 0.4), ("menu", 0.75), ("share", 0.15), ("ad", 0.4), ("form", 0.15), ("side", 0.15)) if r.random() < p]
        after = [] if alone else [k for k, p in (("share", 0.2), ("ad", 0.2), ("comment", 0.35), ("form", 0.15), ("side", 0.4), ("menu", 0.08), ("notice", 0.12), ("footer", 0.75)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        middle = self.main() if r.random() < 0.97 else ""
        if r.random() < 0.4:
            middle = f"<div{self.name('plain')}>{middle}{''.join(map(self.part, after[:2]))}</div>"
            after = after[2:]
        body = "".join(map(self.part, before)) + middle + "".join(map(self.part, after))
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<div{self.name('plain')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


def example(seed: int) -> tuple[list[Block], np.ndarray]:
    out, labels = [], []
    for b in blocks(Maker(seed).page()):
        marks = b.text.count(MAIN), b.text.count(OTHER)
        text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split())
        if text:
            out.append(Block(text, b.path, b.linked))
            labels.append(float(marks[0] > marks[1]))
    return out, np.array(labels, dtype=np.float32)


def _backward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of one direction for x, w, u and b; the forward pass is done again with its gates kept."""
    steps, n, _ = x.shape
    H = M.HIDDEN
    h = c = np.zeros((n, H), dtype=x.dtype)
    kept = []
    ready = x @ w + b
    for t in range(steps):
        z = ready[t] + h @ u
        i, f, o, g = M.sigmoid(z[:, :H]), M.sigmoid(z[:, H : 2 * H]), M.sigmoid(z[:, 2 * H : 3 * H]), np.tanh(z[:, 3 * H :])
        before, c0 = h, c
        c = f * c + i * g
        s = np.tanh(c)
        h = o * s
        kept.append((before, c0, i, f, o, g, s))
    dz = np.zeros((steps, n, 4 * H), dtype=x.dtype)
    du = np.zeros_like(u)
    dh = dc = np.zeros((n, H), dtype=x.dtype)
    for t in range(steps - 1, -1, -1):
        before, c0, i, f, o, g, s = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - s * s)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += before.T @ dz[t]
        dh = dz[t] @ u.T
        dc = dc * f
    flat = dz.reshape(-1, 4 * H)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, H = M.PATH_SIZE + M.WORD_SIZE + M.N_NUMBERS, M.HIDDEN

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"paths": normal(M.PATHS, M.PATH_SIZE, scale=0.3), "words": normal(M.WORDS, M.WORD_SIZE, scale=0.1)}
    for k in "fb":
        p |= {f"{k}w": normal(d, 4 * H, scale=d**-0.5), f"{k}u": normal(H, 4 * H, scale=H**-0.5), f"{k}b": np.zeros(4 * H, dtype=np.float32)}
        p[f"{k}b"][H : 2 * H] = 1
    return p | {"out": normal(2 * H + d, scale=0.1), "bias": np.zeros(1, dtype=np.float32)}


def step(p: dict[str, np.ndarray], batch: list[tuple[tuple, np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch and the gradients."""
    lengths = np.array([len(y) for _, y in batch])
    T, n, H = lengths.max(), len(batch), M.HIDDEN
    x = np.zeros((T, n, p["fw"].shape[0]), dtype=np.float32)
    y, on = np.zeros((T, n), dtype=np.float32), np.zeros((T, n), dtype=np.float32)
    for k, ((pr, pe, wr, we, nums), label) in enumerate(batch):
        x[: lengths[k], k] = np.concatenate([M.mean_rows(p["paths"], pr, pe), M.mean_rows(p["words"], wr, we), nums], axis=1)
        y[: lengths[k], k], on[: lengths[k], k] = label, 1
    back = M.reversed_pages(x, lengths)
    ahead = M.run_lstm(x, p["fw"], p["fu"], p["fb"])
    behind = M.reversed_pages(M.run_lstm(back, p["bw"], p["bu"], p["bb"]), lengths)
    top = np.concatenate([ahead, behind, x], axis=2)
    q = M.sigmoid(top @ p["out"] + p["bias"])
    total = on.sum()
    loss = -float(((y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)) * on).sum() / total)
    d = (q - y) * on / total
    g = {"out": (top * d[:, :, None]).sum(axis=(0, 1)), "bias": d.sum(keepdims=True).reshape(1)}
    d_top = d[:, :, None] * p["out"]
    dx, g["fw"], g["fu"], g["fb"] = _backward(x, p["fw"], p["fu"], p["fb"], d_top[:, :, :H])
    dr, g["bw"], g["bu"], g["bb"] = _backward(back, p["bw"], p["bu"], p["bb"], M.reversed_pages(np.ascontiguousarray(d_top[:, :, H : 2 * H]), lengths))
    dx += M.reversed_pages(dr, lengths) + d_top[:, :, 2 * H :]
    g["paths"], g["words"] = np.zeros_like(p["paths"]), np.zeros_like(p["words"])
    for k, ((pr, pe, wr, we, _), _) in enumerate(batch):
        own = dx[: lengths[k], k]
        for name, rows, ends, part in (("paths", pr, pe, own[:, : M.PATH_SIZE]), ("words", wr, we, own[:, M.PATH_SIZE : M.PATH_SIZE + M.WORD_SIZE])):
            size = np.diff(ends)
            np.add.at(g[name], rows, np.repeat(part / size[:, None], size, axis=0))
    return loss, g


def train(pages: int = 12_000, epochs: int = 6, size: int = 48, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    found = [example(seed * 1_000_003 + k) for k in range(pages)]
    data = [(M.inputs(b), y) for b, y in found if len(b)]
    p = start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t, total = 0, epochs * (len(data) // size)
    for epoch in range(epochs):
        by_size = sorted(range(len(data)), key=lambda i: len(data[i][1]) + rng.random() * 8)
        groups = [by_size[k : k + size] for k in range(0, len(by_size) - size + 1, size)]
        losses = []
        for k in rng.permutation(len(groups)):
            batch = []
            for i in groups[k]:
                (pr, pe, wr, we, nums), y = data[i]
                if rng.random() < 0.15:  # words alone don't decide
                    wr = rng.integers(0, M.WORDS, len(wr))
                if rng.random() < 0.2:  # nor do names and tags that nobody has seen
                    pr = np.where(rng.random(len(pr)) < 0.15, rng.integers(0, M.PATHS, len(pr)), pr)
                batch.append(((pr, pe, wr, we, nums), y))
            loss, g = step(p, batch)
            losses.append(loss)
            t += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = 0.01 * (1 - t / (total + 1)) * min(1.0, 1.0 / (norm + 1e-9))
            for name, x in g.items():
                m[name] = 0.9 * m[name] + 0.1 * x
                v[name] = 0.999 * v[name] + 0.001 * x * x
                p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        print(epoch, round(float(np.mean(losses)), 4), file=sys.stderr)
    return p


if __name__ == "__main__":
    trained = train()
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else M.WEIGHTS, **{k: x.astype(np.float16) for k, x in trained.items()})
