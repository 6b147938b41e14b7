"""Stop-word presets.

Fixed values: common function words of English and Chinese.
"""

from __future__ import annotations

ENGLISH = """
a about above after again against all am an and any are as at be because been before
being below between both but by can could did do does doing down during each few for
from further had has have having he her here hers herself him himself his how i if in
into is it its itself just me more most my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the their
theirs them themselves then there these they this those through to too under until up
very was we were what when where which while who whom why will with would you your yours
yourself yourselves
"""

CHINESE = """
一 一些 一切 一旦 一样 一直 一般 一面 上 下 不 不仅 不但 不会 不光 不只 不可 不同 不如 不得 不是 不过
与 与其 且 个 为 为了 为什么 之 之一 之前 之后 之间 乎 也 也是 也许 了 于 于是 些 人们 今 从 从而 他 他们
以 以上 以下 以及 以后 以来 以至 们 任何 但 但是 何 何况 作为 你 你们 使 使得 依 依据 便 促 借 倘若 做
先后 关于 其 其中 其他 其实 其次 再 再者 几 几乎 凡 凡是 别 别的 到 则 前后 却 即 即使 即便 又 又是 及
及其 及时 反之 另 另一 另外 只 只是 只有 只要 叫 可 可以 可是 吗 吧 否则 呀 呢 和 咱们 哪 哪些 哪里 哪怕
啊 嘛 因 因为 因此 因而 在 地 多少 太 她 她们 好像 如 如何 如果 如此 它 它们 对 对于 将 尽管 就 就是
已 已经 并 并且 得 很 怎么 怎样 总之 我 我们 所 所以 所有 把 是 是否 有 有些 有的 此 的 着 而 而且 让 那 那些 都 还 这
"""

PRESETS = ("en", "zh", "auto")


def words(preset: str = "auto") -> list[str]:
    """The words of a preset; ``auto`` is all of them."""
    if preset not in PRESETS:
        raise ValueError(f"stop-word preset must be one of {PRESETS}, got {preset!r}")
    out: list[str] = []
    if preset in ("en", "auto"):
        out += ENGLISH.split()
    if preset in ("zh", "auto"):
        out += CHINESE.split()
    return out
