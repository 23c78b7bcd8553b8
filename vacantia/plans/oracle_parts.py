"""SQL fragments shared by the oracle texts (DuckDB dialect)."""


def norm(x: str) -> str:
    """Company identity key."""
    suffix = (r"\b(inc|llc|ltd|corp|corporation|co|company|technologies|technology|labs|"
              r"holdings|group|usa|us)\b")
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({x})),"
            f"'[,\\.''’]','','g'),'{suffix}','','g'),'\\s+',' ','g'))")


def grad(title: str, jd: str) -> str:
    """New-grad flag."""
    senior = r"\b(senior|staff|principal|lead|manager|director|sr\.?)\b"
    signal = (r"\b(new ?grad(uate)?|university grad(uate)?|entry.?level|early career|campus|"
              r"(software|swe).{0,30}(intern(ship)?\b|20(2[6-9])))\b")
    return (f"(NOT regexp_matches({title},'{senior}','i') AND (regexp_matches({title},'{signal}','i')"
            f" OR regexp_matches(substr(coalesce({jd},''),1,2000),'{signal}','i')))")


def tokens(x: str) -> str:
    """Tokens sorted and joined."""
    return f"array_to_string(list_sort(string_split(trim(regexp_replace({x},'\\s+',' ','g')),' ')),' ')"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, as a fold over one row of the table."""
    return (f"(CASE WHEN {a}='' OR {b}='' THEN 0 ELSE list_last(list_reduce(string_split({a},''), lambda p, x: "
            f"list_reduce(range(1,length({b})+1), lambda q, j: list_append(q, CASE WHEN x=substr({b},j,1) "
            f"THEN p[j]+1 ELSE greatest(p[j+1], q[j]) END), [0::BIGINT]), "
            f"list_resize([]::BIGINT[], length({b})+1, 0))) END)")


def trigrams(x: str) -> str:
    words = f"regexp_extract_all(lower({x}),'[a-z0-9]+')"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
            f"range(1,length(w)+2), lambda i: substr('  '||w||' ',i,3)))))")


def milli(a: str, d: str, y: str, fy: str) -> str:
    """Sponsor score in thousandths."""
    n = f"({a}+{d}+5)"
    return (f"(CASE WHEN {a}<=0 THEN 50 ELSE 10*least({a},50) + "
            f"CASE WHEN coalesce({y},0)>={fy}-2 THEN 200 ELSE 120 END + (600*{a}+{n})//(2*{n}) END)")


def status(m: str) -> str:
    return f"CASE WHEN {m}>=500 THEN 'verified' WHEN {m}>=200 THEN 'likely' ELSE 'unlikely' END"


def badge(s: str) -> str:
    return f"CASE {s} WHEN 'verified' THEN '\U0001f7e2' WHEN 'likely' THEN '\U0001f7e1' ELSE '⚪' END"
