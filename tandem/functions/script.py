"""Conversion between traditional and simplified script: longest phrase first, then single characters.

A dictionary is a parameter, two columns of phrases; several are applied in a chain or merged. The default holds characters that the fixtures need; a full one can be given as a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Traditional and simplified characters that differ, in the same order. A whole dictionary is given as a table.
TRADITIONAL = "話間後記這個們來時會說對為國學長開關門書車馬鳥魚見語讀錄圖張點體電東業義習鄉買亂爭亞產親億僅從倉儀價眾優傘偉傳傷倫偽兒兩岡冊農決況凍淨減幾鳳憑擊劃劉則剛創劇勞勢勵勸區醫華協單賣盧衛卻廠廳歷壓縣參雙發變葉號嘆嗎啟員響園圍圓聖場壞塊堅壇墳夢夠頭奪奮獎婦媽孫寧寶實審憲宮寬賓將尋導壽專層屬歲島嶺幣師帳帶幫廣慶庫應廟廢異棄彈強歸當彥徑復懷態憐總戀恆惡惱悅懸驚懼慘慣願戰戲戶"
SIMPLIFIED = "话间后记这个们来时会说对为国学长开关门书车马鸟鱼见语读录图张点体电东业义习乡买乱争亚产亲亿仅从仓仪价众优伞伟传伤伦伪儿两冈册农决况冻净减几凤凭击划刘则刚创剧劳势励劝区医华协单卖卢卫却厂厅历压县参双发变叶号叹吗启员响园围圆圣场坏块坚坛坟梦够头夺奋奖妇妈孙宁宝实审宪宫宽宾将寻导寿专层属岁岛岭币师帐带帮广庆库应庙废异弃弹强归当彦径复怀态怜总恋恒恶恼悦悬惊惧惨惯愿战戏户"
MAX_PHRASES = 200_000
#: Characters that are matched at once.
BLOCK = 1 << 20


class Phrases:
    """A dictionary as a trie over numpy arrays. All places of a text walk down it together, a character a step, and those that fall out of it stop.

    Nodes are numbered by depth; `edges` holds node << 21 | code point of every edge in order, and `target` where it leads. `value` has the number of the
    replacement of each node's phrase, -1 where none ends.
    """

    def __init__(self, pairs: dict[str, str]):
        phrases = sorted(p for p in pairs if p)
        self.replacements = [pairs[p] for p in phrases]
        points = np.frombuffer("".join(phrases).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(p) for p in phrases], np.int64)
        first = np.cumsum(sizes) - sizes
        node, nodes, depth, ends = np.zeros(len(phrases), np.int64), 1, 0, np.zeros(len(phrases), np.int64)
        edges, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        alive = np.arange(len(phrases))
        while len(alive):
            code, at = np.unique(node[alive] << 21 | points[first[alive] + depth], return_inverse=True)
            edges.append(code)
            targets.append(nodes + np.arange(len(code)))
            node[alive] = nodes + at
            nodes, depth = nodes + len(code), depth + 1
            ends[alive[sizes[alive] == depth]] = node[alive[sizes[alive] == depth]]
            alive = alive[sizes[alive] > depth]
        order = np.argsort(every := np.concatenate(edges))
        self.edges, self.target, self.longest = every[order], np.concatenate(targets)[order], depth
        self.value = np.full(nodes, -1, np.int64)
        self.value[ends] = np.arange(len(phrases))

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest phrase that begins there, 0 if none does, and its number."""
        size, number = np.zeros(len(points), np.int64), np.full(len(points), -1, np.int64)
        at, node, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        while len(at) and len(self.edges):
            code = node << 21 | points[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, code), len(self.edges) - 1)
            found = self.edges[edge] == code
            at, node, depth = at[found], self.target[edge[found]], depth + 1
            value = self.value[node]
            size[at[value >= 0]], number[at[value >= 0]] = depth, value[value >= 0]
            inside = at + depth < len(points)
            at, node = at[inside], node[inside]
        return size, number

    def replace(self, text: str) -> str:
        """text with the longest phrase at each place replaced, from left to right; what was replaced is not looked at again."""
        out, begin = [], 0
        while begin < len(text):
            # a block brings the characters that a phrase at its end may reach
            part = text[begin : begin + BLOCK + self.longest]
            size, number = self.matches(np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64))
            starts, at, most = np.flatnonzero(size).tolist(), 0, min(len(part), BLOCK)
            sizes, numbers = size[starts].tolist(), number[starts].tolist()
            for i, n, k in zip(starts, sizes, numbers):
                if i >= most:
                    break
                if i >= at:
                    out += (part[at:i], self.replacements[k])
                    at = i + n
            out.append(part[at:most])
            begin += max(at, most)
        return "".join(out)


def chain(*dictionaries: dict[str, str]):
    """Column -> Column: the dictionaries one after the other, each on what the one before made. Single characters alone go by translate(); phrases need one pass in Arrow batches."""
    if all(len(a) == len(b) == 1 for pairs in dictionaries for a, b in pairs.items()):

        def translated(c):
            for pairs in dictionaries:
                c = F.translate(c, "".join(pairs), "".join(pairs.values()))
            return c

        return translated
    steps = [Phrases(pairs) for pairs in dictionaries]

    def converted(text: str) -> str:
        for phrases in steps:
            text = phrases.replace(text)
        return text

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(converted, na_action="ignore")

    return convert


def converter(pairs: dict[str, str]):
    """Column -> Column by one dictionary."""
    return chain(pairs)


def merged(*dictionaries: dict[str, str]) -> dict[str, str]:
    """One dictionary of several that are looked up together; of equal phrases the first one counts."""
    out: dict[str, str] = {}
    for pairs in dictionaries:
        out = pairs | out
    return out


def dictionary(table: DataFrame, source: str, target: str) -> dict[str, str]:
    """A phrase table, checked to be small, as a mapping; of a phrase's several targets the smallest."""
    rows = table.where(F.col(source) != "").groupBy(source).agg(F.min(target).alias("_to")).limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError("the phrase table is too large to convert by")
    return {r[0]: r[1] for r in rows}


to_cn = converter(dict(zip(TRADITIONAL, SIMPLIFIED)))
to_tw = converter(dict(zip(SIMPLIFIED, TRADITIONAL)))


def to_target_script(text, target: Column, cn=to_cn, tw=to_tw) -> Column:
    t = strip(text)
    return F.when(target == "cn", cn(t)).when(target == "tw", tw(t)).otherwise(t)
