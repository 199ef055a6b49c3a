"""Language identities: a terminological three-letter code and, where it isn't implied, a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.session import saved, small

#: Bibliographic codes and the terminological ones that replace them.
TERMINOLOGICAL = dict(
    pair.split("=")
    for pair in "alb=sqi arm=hye baq=eus bur=mya chi=zho cze=ces dut=nld fre=fra geo=kat ger=deu gre=ell ice=isl mac=mkd mao=mri may=msa per=fas rum=ron slo=slk tib=bod wel=cym".split()
)
#: ISO 639-1 codes (older forms included) and their terminological codes.
TWO_LETTER = dict(
    pair.split("=")
    for pair in (
        "aa=aar ab=abk ae=ave af=afr ak=aka am=amh an=arg ar=ara as=asm av=ava ay=aym az=aze ba=bak be=bel bg=bul bh=bih bi=bis bm=bam bn=ben bo=bod br=bre bs=bos "
        "ca=cat ce=che ch=cha co=cos cr=cre cs=ces cu=chu cv=chv cy=cym da=dan de=deu dv=div dz=dzo ee=ewe el=ell en=eng eo=epo es=spa et=est eu=eus fa=fas ff=ful fi=fin fj=fij "
        "fo=fao fr=fra fy=fry ga=gle gd=gla gl=glg gn=grn gu=guj gv=glv ha=hau he=heb hi=hin ho=hmo hr=hrv ht=hat hu=hun hy=hye hz=her ia=ina id=ind ie=ile ig=ibo ii=iii ik=ipk "
        "in=ind io=ido is=isl it=ita iu=iku iw=heb ja=jpn ji=yid jv=jav ka=kat kg=kon ki=kik kj=kua kk=kaz kl=kal km=khm kn=kan ko=kor kr=kau ks=kas ku=kur kv=kom kw=cor ky=kir "
        "la=lat lb=ltz lg=lug li=lim ln=lin lo=lao lt=lit lu=lub lv=lav mg=mlg mh=mah mi=mri mk=mkd ml=mal mn=mon mo=mol mr=mar ms=msa mt=mlt my=mya na=nau nb=nob nd=nde ne=nep "
        "ng=ndo nl=nld nn=nno no=nor nr=nbl nv=nav ny=nya oc=oci oj=oji om=orm or=ori os=oss pa=pan pi=pli pl=pol ps=pus pt=por qu=que rm=roh rn=run ro=ron ru=rus rw=kin sa=san "
        "sc=srd sd=snd se=sme sg=sag si=sin sk=slk sl=slv sm=smo sn=sna so=som sq=sqi sr=srp ss=ssw st=sot su=sun sv=swe sw=swa ta=tam te=tel tg=tgk th=tha ti=tir tk=tuk tl=tgl "
        "tn=tsn to=ton tr=tur ts=tso tt=tat tw=twi ty=tah ug=uig uk=ukr ur=urd uz=uzb ve=ven vi=vie vo=vol wa=wln wo=wol xh=xho yi=yid yo=yor za=zha zh=zho zu=zul"
    ).split()
)
#: The script a language is written in unless another is named.
IMPLIED_SCRIPT = {"Latn": ("aze", "bos", "msa", "tuk", "uzb"), "Cyrl": ("mon", "srp"), "Guru": ("pan",)}
#: The script that a language with a country implies.
COUNTRY_SCRIPT = {("zho", "TW"): "Hant", ("zho", "CN"): "Hans"}
#: Specific languages and the macro language that they belong to.
MACRO = {"nno": "nor", "nob": "nor"}
#: Names of languages, for display.
NAMES = dict(
    pair.split("=")
    for pair in (
        "ara=Arabic bod=Tibetan bul=Bulgarian cat=Catalan ces=Czech cym=Welsh dan=Danish deu=German ell=Greek eng=English est=Estonian eus=Basque fas=Persian fin=Finnish fra=French "
        "heb=Hebrew hrv=Croatian hun=Hungarian hye=Armenian ind=Indonesian isl=Icelandic ita=Italian jpn=Japanese kat=Georgian kor=Korean lav=Latvian lit=Lithuanian mkd=Macedonian "
        "mri=Maori msa=Malay mya=Burmese nld=Dutch nor=Norwegian pol=Polish por=Portuguese ron=Romanian rus=Russian slk=Slovak slv=Slovenian spa=Spanish sqi=Albanian srp=Serbian swe=Swedish "
        "tha=Thai tur=Turkish ukr=Ukrainian vie=Vietnamese zho=Chinese"
    ).split()
)
#: The languages of the core tier.
CORE = tuple("ara bul cat ces dan deu ell eng est fas fin fra heb hrv hun ind ita kor lav lit nld nno nob pol por ron rus slk slv spa srp swe tha tur ukr vie zho".split())


def parse(tag: Column) -> Column:
    """struct(lang, script) of a BCP-47 tag; lang is null where no language code can be told.

    script is '' unless the tag has one that the language doesn't imply.
    """
    parts = F.split(F.trim(tag), "-")
    first = F.lower(F.get(parts, F.lit(0)))
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in {**TWO_LETTER, **TERMINOLOGICAL}.items() for x in p]), first), F.when(first.rlike("^[a-z]{3}$"), first))
    rest = F.when(F.size(parts) > 1, F.slice(parts, 2, 8)).otherwise(F.array().cast("array<string>"))
    written = F.get(F.filter(rest, lambda p: p.rlike("^[A-Za-z]{4}$")), F.lit(0))
    country = F.upper(F.get(F.filter(rest, lambda p: p.rlike("^([A-Za-z]{2}|[0-9]{3})$")), F.lit(0)))
    script = F.coalesce(F.concat(F.upper(written.substr(1, 1)), F.lower(written.substr(2, 3))), F.lit(""))
    for (lang, where), implied in COUNTRY_SCRIPT.items():
        script = F.when((script == "") & (code == lang) & (country == where), F.lit(implied)).otherwise(script)
    for implied, langs in IMPLIED_SCRIPT.items():
        script = F.when((script == implied) & code.isin(*langs), F.lit("")).otherwise(script)
    return F.struct(code.alias("lang"), script.alias("script"))


def name(locale: Column) -> Column:
    """lang, or lang-Script."""
    return F.when(locale["script"] == "", locale["lang"]).otherwise(F.concat_ws("-", locale["lang"], locale["script"]))


def display(locale: Column) -> Column:
    """'code (Name)'; a language without a known name shows its code."""
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in NAMES.items() for x in p]), locale["lang"]), locale["lang"])
    return F.format_string("%s (%s)", name(locale), shown)


def strictly_equal(a: Column, b: Column) -> Column:
    """Same language, same script."""
    return (a["lang"] == b["lang"]) & (a["script"] == b["script"])


def weakly_equal(result: Column, target: Column) -> Column:
    """Whether result satisfies target: its language or one it belongs to, in any script unless target names one."""
    macro = F.try_element_at(F.create_map(*[F.lit(x) for p in MACRO.items() for x in p]), result["lang"])
    return ((result["lang"] == target["lang"]) | F.coalesce(macro == target["lang"], F.lit(False))) & ((target["script"] == "") | (result["script"] == target["script"]))


def supported(wanted: DataFrame, models: DataFrame, tag: str = "lang") -> DataFrame:
    """Rows of wanted whose tag some model satisfies; models has one row per language tag."""
    have = models.select(parse(F.col("lang")).alias("__have")).distinct()
    # tags are told apart first: rows meet the few that are supported by equality alone
    tags = wanted.select(F.col(tag).alias("__tag")).distinct().withColumn("__want", parse(F.col("__tag")))
    good = tags.join(have, weakly_equal(F.col("__have"), F.col("__want")), "left_semi").select("__tag")
    return wanted.join(small(saved(good, "tags")), F.col(tag) == F.col("__tag"), "left_semi")


def rejected(rows: DataFrame, tag: str = "lang") -> DataFrame:
    """Rows whose tag names no language, null and empty ones among them."""
    return rows.where(parse(F.col(tag))["lang"].isNull())
