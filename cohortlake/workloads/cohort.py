"""Cohort building: paths, phenotype clean-up, joins, integrity, splits, balance, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import metadata as M
from cohortlake.functions import paths as P
from cohortlake.operators import audit, balance, cohort, splits
from cohortlake.operators.ordered import sorted_rank
from cohortlake.session import fresh_path
from cohortlake.sources import tables
from cohortlake.workloads.standins import table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- stand-in expressions, the same text in Spark and DuckDB ----------------------------------

SUB = "lpad(cast(o_custkey as string), 7, '0')"
PATH = f"""case o_orderkey % 10
 when 0 then '/data/raw/site_' || cast(o_custkey % 25 as string) || '/sub-' || {SUB} || '/scan_' || cast(o_orderkey as string) || '_T1w.nii'
 when 1 then '/data/raw/sub-' || {SUB} || '/anat/s' || cast(o_orderkey as string) || '_T1w.nii.gz'
 when 2 then '/data/raw/loose/s' || cast(o_orderkey as string) || '_T1w.nii.gz'
 when 3 then '/data/raw/site_1/sub-' || {SUB} || '/func/sub-' || {SUB} || '_run-' || cast(o_orderkey as string) || '_bold.nii.gz'
 else '/data/raw/site_' || cast(o_custkey % 25 as string) || '/sub-' || {SUB} || '/anat/sub-' || {SUB} || '_run-' || cast(o_orderkey as string) || '_T1w.nii.gz' end"""
REL = """(case o_orderkey % 9 when 0 then 'AD/' when 1 then 'cn/' when 2 then 'Control/' when 3 then 'site_a/TUMOR/' when 4 then 'batch7/' when 5 then 'HEAD_cohort/' when 6 then 'normal/x/' else '' end)
 || 's' || cast(o_custkey as string) || '/' || (case o_orderkey % 4 when 0 then 'HEAD_scan' when 1 then 'autism_v' when 2 then 't1' else 'cnt' end) || cast(o_orderkey as string) || '.nii.gz'"""
FOLDER = """(case o_orderkey % 8 when 0 then 'CONTROL' when 1 then 'asd' when 2 then 'MyControls' when 3 then 'autism_grp' when 4 then 'AD' when 5 then 'mci_2' when 6 then 'Normal' else 'misc' end)"""
TAIL = """(case o_orderkey % 5 when 0 then '/scan_' || cast(o_orderkey as string) || '.nii.gz' when 1 then '/slice_' || cast(o_orderkey as string) || '.dcm' when 2 then '/series/i' || cast(o_orderkey as string) || '.dcm' when 3 then '/readme.txt' else '/scan_' || cast(o_orderkey as string) || '.nii' end)"""


def files(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("cust"),
        F.expr(PATH).alias("path"), F.expr(REL).alias("rel"), F.expr(FOLDER).alias("class_dir"), F.expr(TAIL).alias("tail"),
    )


FILES = f"files AS (SELECT o_orderkey AS scan_id, o_custkey AS cust, {PATH} AS path, {REL} AS rel, {FOLDER} AS class_dir, {TAIL} AS tail FROM orders)"
W = "WITH " + FILES

# phenotype: two rows per SUB_ID (the later file row wins), sentinels in every flavour
RAW = {
    "SUB_ID": "cast(c_custkey - c_custkey % 2 as string)",
    "DX_GROUP": "c_nationkey % 3",
    "SEX": "c_nationkey % 2 + 1",
    "AGE_AT_SCAN": "case when c_acctbal < 0 then '-9999' when c_custkey % 7 = 0 then ' nan ' else cast(c_custkey % 60 as string) || '.5' end",
    "SITE_ID": "' site_' || cast(c_nationkey as string) || ' '",
    "FIQ": "case c_custkey % 5 when 0 then '-9999.0' when 1 then '' when 2 then 'n/a' else cast(80 + c_custkey % 50 as string) end",
    "VIQ": "case when c_custkey % 3 = 0 then 'NaN' else cast(90 + c_custkey % 20 as string) || '.0' end",
    "row_no": "c_custkey",
}


def raw_phenotype(spark, sf):
    return table(spark, sf, "customer").selectExpr(*[f"{e} AS {n}" for n, e in RAW.items()])


def phenotype(spark, sf):
    return cohort.clean_phenotype(raw_phenotype(spark, sf), "row_no")


_NUM = "CASE WHEN trim({c}) NOT IN ('-9999','-9999.0','NaN','nan','') THEN try_cast(trim({c}) AS DOUBLE) END"
PHENO = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + f""" FROM customer),
pheno AS (SELECT CAST(SUB_ID AS BIGINT) AS sub_key, trim(SITE_ID) AS site, CASE DX_GROUP WHEN 1 THEN 'ASD' WHEN 2 THEN 'CONTROL' END AS label,
 {_NUM.format(c='AGE_AT_SCAN')} AS age, CASE SEX WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex, {_NUM.format(c='FIQ')} AS fiq, {_NUM.format(c='VIQ')} AS viq
 FROM (SELECT *, row_number() OVER (PARTITION BY SUB_ID ORDER BY row_no DESC) rn FROM raw) WHERE rn=1)"""
DIGITS = "coalesce(nullif(regexp_extract(split_part(path,'/',-1),'sub-(\\d+)',1),''), nullif(regexp_extract(split_part(path,'/',-2),'sub-(\\d+)',1),''), nullif(regexp_extract(split_part(path,'/',-3),'sub-(\\d+)',1),''))"
INDEX = f"""{FILES}, {PHENO}, idx AS (SELECT 'sub-' || d AS subject_id, path, CAST(d AS BIGINT) AS sub_key, coalesce(site,'Unknown') AS site, label, age, sex, fiq, viq, pheno.sub_key IS NOT NULL AS has_phenotype
 FROM (SELECT path, {DIGITS} AS d FROM files WHERE regexp_matches(split_part(path,'/',-1),'_T1w\\.nii')) s LEFT JOIN pheno ON pheno.sub_key=CAST(d AS BIGINT) WHERE d IS NOT NULL)"""


def index(spark, sf):
    return cohort.build_index(files(spark, sf).select("path"), phenotype(spark, sf))


# --- paths ------------------------------------------------------------------------------------

@query("P01_reroot_path", W + """ SELECT path, '/new/' || CASE WHEN regexp_matches(path,'/sub-') THEN regexp_extract(path, '([^/]*/sub-.*)$', 1) ELSE split_part(path,'/',-1) END AS moved FROM files""")
def _(spark, sf):
    return files(spark, sf).select("path", P.reroot(F.col("path"), "/new").alias("moved"))


@query("P01_reroot_urls", """SELECT page_id, '/new/' || regexp_extract(split_part(url,'?',1), '([^/]+)/*$', 1) AS moved FROM pages""")
def _(spark, sf):
    url = F.substring_index("url", "?", 1)
    return table(spark, sf, "pages").select("page_id", P.reroot(url, "/new").alias("moved"))


@query("P02_subject_from_path", W + f" SELECT path, {DIGITS} AS digits, CAST({DIGITS} AS BIGINT) AS sub_key FROM files WHERE regexp_matches(split_part(path,'/',-1),'_T1w\\.nii')")
def _(spark, sf):
    p = F.col("path")
    return files(spark, sf).where(P.is_t1w(p)).select(
        "path", P.subject_digits(p).alias("digits"), P.subject_key(p).alias("sub_key")
    )


@query("P03_folder_subject", W + """ SELECT rel, CASE WHEN upper(split_part(rel,'/',1)) IN ('AD','CN','CONTROL','TUMOR','AUTISM','NORMAL') THEN split_part(rel,'/',2) ELSE split_part(rel,'/',1) END AS subject FROM files""")
def _(spark, sf):
    return files(spark, sf).select("rel", P.folder_subject(F.col("rel")).alias("subject"))


_CLS = ["AD", "CN", "CONTROL", "TUMOR", "AUTISM", "NORMAL"]
PATH_CLASS = """coalesce((SELECT upper(x) FROM (SELECT unnest(string_split(rel,'/')[:-2]) x, generate_subscripts(string_split(rel,'/')[:-2],1) i) WHERE upper(x) IN ('AD','CN','CONTROL','TUMOR','AUTISM','NORMAL') ORDER BY i DESC LIMIT 1), CASE """ + " ".join(
    f"WHEN contains(upper(split_part(rel,'/',-1)),'{c}') THEN '{c}'" for c in _CLS) + " ELSE 'Unknown' END)"


@query("P04_class_from_path", W + f" SELECT rel, {PATH_CLASS} AS class FROM files")
def _(spark, sf):
    return files(spark, sf).select("rel", P.path_class(F.col("rel")).alias("class"))


TWO = "CASE WHEN upper(class_dir) IN ('CONTROL','ASD') THEN upper(class_dir) WHEN contains(upper(class_dir),'CONTROL') THEN 'CONTROL' WHEN contains(upper(class_dir),'ASD') OR contains(upper(class_dir),'AUTISM') THEN 'ASD' END"
THREE = "CASE WHEN upper(class_dir) IN ('CN','AD','MCI') THEN upper(class_dir) WHEN contains(upper(class_dir),'CN') OR contains(upper(class_dir),'NORMAL') OR contains(upper(class_dir),'CONTROL') THEN 'CN' WHEN contains(upper(class_dir),'AD') OR contains(upper(class_dir),'ALZHEIMER') THEN 'AD' WHEN contains(upper(class_dir),'MCI') THEN 'MCI' END"


@query("P05_two_class_folder", W + f" SELECT scan_id, {TWO} AS label FROM files WHERE {TWO} IS NOT NULL")
def _(spark, sf):
    df = files(spark, sf).select("scan_id", P.two_class_label(F.col("class_dir")).alias("label"))
    return df.where("label IS NOT NULL")


@query("P06_F06_three_class_folder", W + f" SELECT scan_id, {THREE} AS label FROM files WHERE {THREE} IS NOT NULL")
def _(spark, sf):
    df = files(spark, sf).select("scan_id", P.three_class_label(F.col("class_dir")).alias("label"))
    return df.where("label IS NOT NULL")


# multimodal layout: subject folder = c_custkey div 4, one file per customer
MODE = "'BraTS_' || cast((c_custkey - c_custkey % 6) as string) || (case when c_custkey % 6 = 0 then '_T1' when c_custkey % 6 = 1 then '_t1ce' when c_custkey % 6 = 2 then '_t2' when c_custkey % 6 = 3 then (case when c_nationkey % 3 = 0 then '_note' else '_flair' end) when c_custkey % 6 = 4 then '_seg' else '_extra' end) || '.nii.gz'"
MODES = f"mods AS (SELECT 'BraTS_' || cast((c_custkey - c_custkey % 6) as string) AS subject_id, {MODE} AS file FROM customer)"
MOD_CASE = "CASE WHEN contains(lower(file),'_seg') THEN 'mask' WHEN contains(lower(file),'_t1ce') THEN 't1ce' WHEN contains(lower(file),'_t1') THEN 't1' WHEN contains(lower(file),'_t2') THEN 't2' WHEN contains(lower(file),'_flair') THEN 'flair' END"


def modality_files(spark, sf):
    sub = F.expr("'BraTS_' || cast((c_custkey - c_custkey % 6) as string)").alias("subject_id")
    return table(spark, sf, "customer").select(sub, F.expr(MODE).alias("path"))


def modality_index(spark, sf):
    df = modality_files(spark, sf)
    return cohort.modality_index(df.select("subject_id"), df)


@query("P07_modality_from_suffix", "WITH " + MODES + f" SELECT file, {MOD_CASE} AS modality FROM mods")
def _(spark, sf):
    return modality_files(spark, sf).select(F.col("path").alias("file"), P.modality(F.col("path")).alias("modality"))


# --- phenotype and header clean-up ------------------------------------------------------------

@query("P08_sentinel_cleaning", f"""WITH {PHENO}, t AS (SELECT row_no, AGE_AT_SCAN a, FIQ f, VIQ v FROM raw)
SELECT row_no, {_NUM.format(c='a')} AS age, {_NUM.format(c='f')} AS fiq, CASE WHEN trim(f) IN ('-9999','-9999.0','NaN','nan','') THEN NULL ELSE trim(f) END AS fiq_text,
CASE WHEN trim(v) IN ('-9999','-9999.0','NaN','nan','') THEN NULL ELSE replace(v,'.0','') END AS viq_text FROM t""")
def _(spark, sf):
    return raw_phenotype(spark, sf).select(
        "row_no", M.clean_number(F.col("AGE_AT_SCAN")).alias("age"), M.clean_number(F.col("FIQ")).alias("fiq"),
        M.clean_text(F.col("FIQ")).alias("fiq_text"), M.clean_text(F.col("VIQ")).alias("viq_text"),
    )


@query("P09_code_maps", f"WITH {PHENO} SELECT row_no, CASE DX_GROUP WHEN 1 THEN 'ASD' WHEN 2 THEN 'CONTROL' END AS label, CASE SEX WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex FROM raw")
def _(spark, sf):
    return raw_phenotype(spark, sf).select(
        "row_no", M.decode(F.col("DX_GROUP"), M.DIAGNOSIS_CODES).alias("label"),
        M.decode(F.col("SEX"), M.SEX_CODES).alias("sex"),
    )


@query("P10_label_codes", W + f" SELECT scan_id, CASE {THREE} WHEN 'CN' THEN 0 WHEN 'AD' THEN 1 ELSE -1 END AS code, CASE {THREE} WHEN 'CN' THEN 'Control' WHEN 'AD' THEN 'Autism' ELSE '-1' END AS name FROM files")
def _(spark, sf):
    code = M.encode_label(P.three_class_label(F.col("class_dir")))
    return files(spark, sf).select("scan_id", code.alias("code"), M.decode_label(code).alias("name"))


def affines(spark, sf):
    """Affine 4x4 and format per embedding; every fifth first column is zero."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    zero = F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(1.0)
    rows = [F.array(e(4 * r + 1) * zero, e(4 * r + 2), e(4 * r + 3), e(4 * r + 4)) for r in range(3)]
    fmt = F.when(F.col("vec_id") % 4 == 0, "image").otherwise("nifti")
    return table(spark, sf, "embeddings").select(
        "vec_id", fmt.alias("fmt"), F.array(*rows, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])).alias("affine"),
        F.array(F.lit(4), F.lit(4), F.when(fmt == "image", 1).otherwise(4)).alias("shape"),
    )


def _norm(c):
    z = "CASE WHEN vec_id%5=0 THEN 0.0 ELSE 1.0 END" if c == 0 else "1.0"
    s = "+".join(f"pow(embedding[{4 * r + c + 1}]::DOUBLE*({z}),2)" for r in range(3))
    return f"CASE WHEN vec_id%4=0 OR {s}=0 THEN 1.0 ELSE sqrt({s}) END"


@query("P11_voxel_spacing", "SELECT vec_id, " + ", ".join(f"round({_norm(c)},6) AS s{c}" for c in range(3)) + " FROM embeddings")
def _(spark, sf):
    sp = M.voxel_spacing(F.col("affine"), F.col("fmt"))
    return affines(spark, sf).select("vec_id", *[r6(sp[c]).alias(f"s{c}") for c in range(3)])


@query("P16_image_metadata", "SELECT vec_id, " + ", ".join(f"round({_norm(c)},6) AS s{c}" for c in range(3)) + ", CASE WHEN vec_id%4=0 THEN '4x4x1' ELSE '4x4x4' END AS dims, CASE WHEN vec_id%4=0 THEN '2D' ELSE 'RAS' END AS orientation, CASE WHEN vec_id%4=0 THEN 'Standard 2D' ELSE 'T1w' END AS modality FROM embeddings")
def _(spark, sf):
    info = M.image_info(F.col("fmt"), F.col("affine"), F.col("shape"))
    df = affines(spark, sf).select("vec_id", info.alias("i"))
    return df.select(
        "vec_id", *[r6(F.col("i.voxel_dims")[c]).alias(f"s{c}") for c in range(3)],
        F.array_join(F.col("i.dimensions").cast("array<string>"), "x").alias("dims"), "i.orientation", "i.modality",
    )


def headers(spark, sf):
    """Tag maps from orders: some tags absent, values with stray blanks."""
    k = F.col("o_orderkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("0008|0070"), F.when(k % 4 != 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))),
            F.lit("0008|1090"), F.when(k % 3 != 0, F.concat(F.lit("m"), k % 6)),
            F.lit("0018|0087"), F.when(k % 5 == 0, "bad").otherwise(F.concat(F.lit(" "), (k % 7).cast("string"), F.lit(".5"))),
            F.lit("0008|0020"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")),
            F.lit("0010|0020"), F.when(k % 6 != 0, F.concat(F.lit("P"), F.col("o_custkey").cast("string"))),
            F.lit("0010|1010"), F.when(k % 4 == 1, F.concat(F.lpad((k % 90).cast("string"), 3, "0"), F.lit("Y")))
            .when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit(".25"))).when(k % 4 == 3, "12M"),
            F.lit("0010|0040"), F.when(k % 3 == 1, "F "),
        ),
        lambda _, v: v.isNotNull(),
    )
    fmt = F.when(k % 8 == 7, "nifti").otherwise("dicom")
    return table(spark, sf, "orders").select(k.alias("scan_id"), fmt.alias("fmt"), tags.alias("header"))


DICOM = "SELECT *, o_orderkey AS k, o_orderkey%8<>7 AS dicom FROM orders"


@query("P12_P14_scanner_metadata", f"WITH d AS ({DICOM}) SELECT k AS scan_id, CASE WHEN dicom THEN CASE WHEN k%4<>0 THEN o_orderpriority ELSE 'Unknown' END END AS manufacturer, CASE WHEN dicom THEN CASE WHEN k%3<>0 THEN 'm' || (k%6) ELSE 'Unknown' END END AS model, CASE WHEN dicom AND k%5<>0 THEN k%7+0.5::DOUBLE END AS field, CASE WHEN dicom AND k%2=0 THEN strftime(o_orderdate,'%Y%m%d') END AS scan_date FROM d")
def _(spark, sf):
    s = M.scanner(F.col("fmt"), F.col("header"))
    df = headers(spark, sf).select("scan_id", s.alias("s"))
    return df.select("scan_id", "s.manufacturer", "s.model", F.col("s.magnetic_field_strength").alias("field"), "s.scan_date")


@query("P13_P15_patient_metadata", f"WITH d AS ({DICOM}) SELECT k AS scan_id, CASE WHEN dicom THEN CASE WHEN k%6<>0 THEN 'P' || o_custkey ELSE 'Anonymous' END ELSE 'Anonymous_Patient' END AS patient_id, CASE WHEN dicom THEN CASE k%4 WHEN 1 THEN (k%90)::DOUBLE WHEN 2 THEN k%90+0.25::DOUBLE END END AS age, CASE WHEN dicom THEN CASE WHEN k%3=1 THEN 'F' ELSE 'Unknown' END END AS gender FROM d")
def _(spark, sf):
    s = M.patient(F.col("fmt"), F.col("header"))
    return headers(spark, sf).select("scan_id", s.alias("p")).select("scan_id", "p.patient_id", "p.age", "p.gender")


@query("P32_record_ids", "SELECT o_orderkey, 'scan_' || substr(md5(CAST(o_orderkey AS VARCHAR)),1,8) AS record_id, 'rep_P' || o_custkey || '_' || CAST(epoch(o_orderdate) AS BIGINT) AS report_id, 'Analysis report generated for patient P' || o_custkey || ' using model probe.' AS summary FROM orders")
def _(spark, sf):
    pid = F.concat(F.lit("P"), F.col("o_custkey").cast("string"))
    when = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select(
        "o_orderkey", M.record_id("scan", F.col("o_orderkey")).alias("record_id"),
        M.report_id(pid, when).alias("report_id"), M.report_summary(pid, F.lit("probe")).alias("summary"),
    )


# --- joins and filters ------------------------------------------------------------------------

@query("J01_scans_with_phenotype", "WITH " + INDEX + " SELECT subject_id, path, site, label, age, sex, fiq, viq, has_phenotype FROM idx")
def _(spark, sf):
    return index(spark, sf).select("subject_id", "path", "site", "label", "age", "sex", "fiq", "viq", "has_phenotype")


@query("S07_W19_phenotype_source", f"WITH {PHENO} SELECT * FROM pheno")
def _(spark, sf):
    return phenotype(spark, sf).drop("piq", "scanner_site")


@query("S07_phenotype_files", f"WITH {PHENO} SELECT * FROM pheno")
def _(spark, sf):
    """Written as text cells in file order, as the last row of a subject counts, and read back by the CSV source."""
    path = fresh_path(spark, "phenotype")
    rows = raw_phenotype(spark, sf).repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no")
    rows.write.csv(path, header=True)
    return cohort.clean_phenotype(tables.read_phenotype(spark, path), "row_no").drop("piq", "scanner_site")


def _documents(rows, bucket, value, name):
    """The folder of one text file per bucket that holds its only ``value``."""
    path = fresh_path(rows.sparkSession, name)
    rows.groupBy(bucket.alias("bucket")).agg(value.alias("value")).write.partitionBy("bucket").text(path)
    return path


INDEXED = ["subject_id", "site", "path", "label", "age", "sex", "fiq", "viq"]


@query("S06_index_files", f"WITH {INDEX} SELECT {', '.join(INDEXED)} FROM idx")
def _(spark, sf):
    """One JSON array of records per thousand subject numbers."""
    of = F.floor(F.regexp_extract("subject_id", "([0-9]+)$", 1).cast("long") / 1000)
    path = _documents(index(spark, sf).select(*INDEXED), of, F.to_json(F.collect_list(F.struct(*INDEXED))), "index")
    return tables.read_index(spark, path).select(*INDEXED)


@query("S08_split_files", "SELECT c_custkey::VARCHAR AS subject_id, CASE WHEN c_custkey%10<7 THEN 'train' WHEN c_custkey%10<9 THEN 'val' ELSE 'test' END AS split FROM customer")
def _(spark, sf):
    named = F.when(F.col("c_custkey") % 10 < 7, "train").when(F.col("c_custkey") % 10 < 9, "val").otherwise("test")
    rows = table(spark, sf, "customer").select("c_custkey", named.alias("split"))
    members = lambda n: F.collect_list(F.when(F.col("split") == n, F.col("c_custkey").cast("string")))
    doc = F.create_map(*[x for n in ("train", "val", "test") for x in (F.lit(n), members(n))])
    path = _documents(rows, F.floor(F.col("c_custkey") / 1000), F.to_json(doc), "splits")
    return tables.read_splits(spark, path)


@query("J02_orphan_scans", "WITH " + INDEX.replace("FROM customer)", "FROM customer WHERE c_custkey % 10 <> 3)") + " SELECT subject_id, path, CASE WHEN NOT has_phenotype THEN 'no phenotype row' ELSE 'no diagnosis label' END AS rule FROM idx WHERE NOT has_phenotype OR label IS NULL")
def _(spark, sf):
    known = cohort.clean_phenotype(raw_phenotype(spark, sf).where("row_no % 10 <> 3"), "row_no")  # the others are orphans
    return cohort.orphan_scans(cohort.build_index(files(spark, sf).select("path"), known))


def subjects(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("site")
    )


@query("J03_F01_S06_split_membership", "WITH s AS (SELECT c_custkey AS subject_id, CASE WHEN c_custkey%10<7 THEN 'train' WHEN c_custkey%10<9 THEN 'val' ELSE 'test' END AS split FROM customer) SELECT o_orderkey AS scan_id, o_custkey AS subject_id FROM orders WHERE o_custkey IN (SELECT subject_id FROM s WHERE split='val')")
def _(spark, sf):
    named = F.when(F.col("c_custkey") % 10 < 7, "train").when(F.col("c_custkey") % 10 < 9, "val").otherwise("test")
    split = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), named.alias("split"))
    scans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("subject_id"))
    return cohort.in_split(scans, split, "val")


@query("J04_F03_pending_work", "SELECT c_custkey AS subject_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')")
def _(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject_id"))
    return cohort.pending(subjects(spark, sf).select("subject_id"), done, "subject_id")


@query("J05_missing_catalog_entries", "SELECT p_partkey AS scan_id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag='R' AND l_quantity>25)")
def _(spark, sf):
    expected = table(spark, sf, "part").select(F.col("p_partkey").alias("scan_id"), F.col("p_name").alias("name"))
    found = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_partkey").alias("scan_id"))
    return cohort.missing_catalog(expected, found, "scan_id")


@query("J06_subject_label_lookup", "SELECT o_orderkey AS scan_id, coalesce(c.c_mktsegment,'Unknown') AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal>=0) c ON c.c_custkey=o_custkey")
def _(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("label")
    )
    scans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("subject_id"))
    return cohort.subject_label(scans, known, "subject_id", "label").select("scan_id", "label")


@query("W09_first_scan_two_class", W + f""", f AS (SELECT class_dir, 's' || cust AS subject_id, {TWO} AS label, class_dir || '/s' || cust || tail AS path FROM files WHERE contains(split_part(tail,'/',-1),'.nii'))
SELECT subject_id, min(path) AS path, any_value(label) AS label, 'nifti' AS format, class_dir FROM f WHERE label IS NOT NULL GROUP BY class_dir, subject_id""")
def _(spark, sf):
    df = _layout(spark, sf)
    return cohort.class_folder_index(df, P.two_class_label(F.col("class_dir")), [("nifti", _nifti())])


def _layout(spark, sf):
    sub = F.concat(F.lit("s"), F.col("cust").cast("string"))
    return files(spark, sf).select(
        "class_dir", sub.alias("subject_id"), F.concat(F.col("class_dir"), F.lit("/"), sub, "tail").alias("path"), "tail"
    )


def _nifti():
    return F.contains(P.basename(F.col("path")), F.lit(".nii")) & (F.size(F.split("path", "/")) == 3)


@query("W09_first_scan_three_class", W + f""", f AS (SELECT class_dir, 's' || cust AS subject_id, {THREE} AS label, class_dir || '/s' || cust || tail AS path,
 CASE WHEN contains(tail,'.nii') THEN 0 WHEN tail LIKE '/slice%.dcm' THEN 1 WHEN tail LIKE '/series/%.dcm' THEN 2 END AS rk FROM files)
SELECT subject_id, path, label, ['nifti','dicom','dicom_series'][rk+1] AS format, class_dir FROM (SELECT *, row_number() OVER (PARTITION BY class_dir, subject_id ORDER BY rk, path) rn FROM f WHERE label IS NOT NULL AND rk IS NOT NULL) WHERE rn=1""")
def _(spark, sf):
    dcm, deep = F.col("path").endswith(".dcm"), F.size(F.split("path", "/")) > 3
    formats = [("nifti", _nifti()), ("dicom", dcm & ~deep), ("dicom_series", dcm & deep)]
    return cohort.class_folder_index(_layout(spark, sf), P.three_class_label(F.col("class_dir")), formats)


@query("W19_last_write_wins", "SELECT o_custkey AS subject_id, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS scan_id FROM orders GROUP BY o_custkey")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("scan_id"), "o_orderdate"
    )
    return cohort.last_write_wins(rows, ["subject_id"], ["o_orderdate", "scan_id"]).select("subject_id", "scan_id")


# --- integrity --------------------------------------------------------------------------------

@query("C04_index_integrity", "WITH " + INDEX + """ SELECT CAST(1 AS INT) AS rule_no, 'missing field label' AS rule, subject_id AS entry FROM idx WHERE label IS NULL
UNION ALL SELECT 2, 'path does not exist', path FROM idx WHERE path NOT IN (SELECT path FROM files WHERE scan_id%13<>0)
UNION ALL SELECT 3, 'duplicate subject', subject_id FROM idx GROUP BY subject_id HAVING count(*)>1
UNION ALL SELECT 4, 'duplicate path', path FROM idx GROUP BY path HAVING count(*)>1""")
def _(spark, sf):
    found = files(spark, sf).where("scan_id % 13 <> 0").select("path")
    return cohort.index_violations(index(spark, sf), found)


@query("U02_distinct_subjects", "SELECT DISTINCT o_custkey AS subject_id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal>5000")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"))
    b = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("subject_id"))
    return a.union(b).distinct()


@query("U03_split_disjoint_cover", "SELECT count(*) AS subjects, count(*) AS members, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS overlaps FROM customer")
def _(spark, sf):
    subs = subjects(spark, sf)
    parts = splits.stratified_split(subs, "subject_id", "label")
    return cohort.split_coverage(parts, subs)


@query("U04_set_difference", "SELECT c_custkey AS subject_id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice>300000")
def _(spark, sf):
    val = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("subject_id"))
    return cohort.missing_catalog(subjects(spark, sf).select("subject_id"), val, "subject_id")


# --- splits -----------------------------------------------------------------------------------

CUST = "s AS (SELECT c_custkey AS subject_id, c_mktsegment AS label, c_nationkey AS site, md5('42:' || c_custkey) AS h FROM customer)"


@query("W01_random_split", f"WITH {CUST}, r AS (SELECT *, row_number() OVER (ORDER BY h, subject_id) rn, count(*) OVER () n FROM s) SELECT subject_id, CASE WHEN rn<=floor(0.8::DOUBLE*n) THEN 'train' WHEN rn<=floor(0.8::DOUBLE*n)+floor(0.1::DOUBLE*n) THEN 'val' ELSE 'test' END AS split FROM r")
def _(spark, sf):
    return splits.random_split(subjects(spark, sf), "subject_id")


@query("W02_kfold", f"WITH {CUST}, r AS (SELECT *, row_number() OVER (ORDER BY h, subject_id) rn, count(*) OVER () n FROM s) SELECT subject_id, CAST(least((rn-1)//(n//7),6) AS INT) AS fold FROM r")
def _(spark, sf):
    return splits.kfold(subjects(spark, sf), "subject_id", 7)


@query("W03_round_robin_kfold", f"WITH {CUST} SELECT subject_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, subject_id)-1)%5 AS INT) AS fold FROM s")
def _(spark, sf):
    return splits.round_robin_kfold(subjects(spark, sf), "subject_id", "label", 5)


@query("W04_group_kfold", f"WITH {CUST} SELECT subject_id, site, CAST((dense_rank() OVER (ORDER BY site)-1)%4 AS INT) AS fold FROM s")
def _(spark, sf):
    return splits.group_kfold(subjects(spark, sf), "subject_id", "site", 4)


STRAT = f"""{CUST}, c AS (SELECT label, count(*) c FROM s GROUP BY label),
t AS (SELECT sum(c) n, ceil(0.3::DOUBLE*sum(c)) held, ceil(0.5::DOUBLE*ceil(0.3::DOUBLE*sum(c))) tst FROM c),
h AS (SELECT label, c, held*(c/n::DOUBLE) e, held, tst FROM c, t),
hq AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY e-floor(e) DESC, label DESC) <= held - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS qh FROM h),
tq0 AS (SELECT *, tst*(qh/held::DOUBLE) e2 FROM hq),
tq AS (SELECT *, floor(e2) + CASE WHEN row_number() OVER (ORDER BY e2-floor(e2) DESC, label DESC) <= tst - sum(floor(e2)) OVER () THEN 1 ELSE 0 END AS qt FROM tq0),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, subject_id) rn FROM s),
sp AS (SELECT subject_id, label, CASE WHEN rn<=qt THEN 'test' WHEN rn<=qh THEN 'val' ELSE 'train' END AS split FROM r JOIN tq USING (label))"""


@query("W05_stratified_split", f"WITH {STRAT} SELECT subject_id, label, split FROM sp")
def _(spark, sf):
    return splits.stratified_split(subjects(spark, sf), "subject_id", "label")


KF = f"{CUST}, kf AS (SELECT subject_id, label, CAST((row_number() OVER (ORDER BY f, h, subject_id)-1)%5 AS INT) AS fold FROM (SELECT *, min(subject_id) OVER (PARTITION BY label) f FROM s))"


@query("W06_stratified_kfold", f"WITH {KF} SELECT * FROM kf")
def _(spark, sf):
    return splits.stratified_kfold(subjects(spark, sf).drop("site"), "subject_id", "label", 5)


ROLES = f"{KF}, roles AS (SELECT subject_id, CAST(i AS INT) AS fold, CASE WHEN fold=i THEN 'val' ELSE 'train' END AS role FROM kf, unnest(range(5)) t(i))"


def _roles(spark, sf):
    folds = splits.stratified_kfold(subjects(spark, sf).drop("site"), "subject_id", "label", 5)
    return splits.expand_folds(folds, "subject_id", 5)


@query("W07_fold_roles", f"WITH {ROLES} SELECT * FROM roles")
def _(spark, sf):
    return _roles(spark, sf)


@query("F02_S08_fold_filter", f"WITH {ROLES} SELECT subject_id, label FROM s WHERE subject_id IN (SELECT subject_id FROM roles WHERE fold=2 AND role='val')")
def _(spark, sf):
    return cohort.in_fold(subjects(spark, sf).drop("site"), _roles(spark, sf), 2, "val", k=5)


@query("S08_fold_files", f"WITH {ROLES} SELECT subject_id::VARCHAR AS subject_id, fold, role FROM roles")
def _(spark, sf):
    """Fold documents of a thousand subjects each, read back as one table of roles."""
    kf = splits.stratified_kfold(subjects(spark, sf).drop("site"), "subject_id", "label", 5)
    members = lambda hit: F.collect_list(F.when(hit, F.col("subject_id").cast("string")))
    doc = F.array(*[
        F.create_map(F.lit("train"), members(F.col("fold") != i), F.lit("val"), members(F.col("fold") == i)) for i in range(5)
    ])
    path = _documents(kf, F.floor(F.col("subject_id").cast("long") / 1000), F.to_json(doc), "folds")
    return tables.read_folds(spark, path).select("subject_id", F.col("fold").cast("int").alias("fold"), "role")


# --- balance and summaries --------------------------------------------------------------------

@query("A11_class_balance", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN c_acctbal<0 THEN 'Unknown' ELSE c_mktsegment END AS label FROM customer) GROUP BY label")
def _(spark, sf):
    label = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return balance.class_balance(table(spark, sf, "customer").select(label.alias("label")), "label", keep_null=True)


@query("A14_dataset_summary", "WITH o AS (SELECT o_custkey, CASE WHEN o_totalprice>50000 THEN o_orderstatus END AS label FROM orders) SELECT 'orders' AS dataset_name, (SELECT count(*) FROM o) AS total_files, (SELECT count(DISTINCT o_custkey) FROM o) AS unique_subjects, label, count(*) AS n FROM o WHERE label IS NOT NULL GROUP BY label")
def _(spark, sf):
    idx = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.when(F.col("o_totalprice") > 50000, F.col("o_orderstatus")).alias("label")
    )
    return balance.dataset_summary(idx, "orders").select(
        "dataset_name", "total_files", "unique_subjects", F.explode("class_distribution").alias("label", "n")
    )


@query("A15_missing_modalities", f"WITH {MODES}, have AS (SELECT DISTINCT subject_id, {MOD_CASE} AS m FROM mods), gap AS (SELECT s.subject_id, e.m AS modality FROM (SELECT DISTINCT subject_id FROM mods) s CROSS JOIN (VALUES ('t1'),('t1ce'),('t2'),('flair')) e(m) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.subject_id=s.subject_id AND h.m=e.m)) SELECT modality, count(*) AS missing FROM gap GROUP BY modality UNION ALL SELECT 'total_missing_channels', count(*) FROM gap")
def _(spark, sf):
    return cohort.missing_modalities(modality_index(spark, sf))


@query("A16_cohort_statistics", "WITH " + INDEX + """ SELECT count(*) AS total_mri_scans, count(DISTINCT subject_id) AS indexed_subjects, count(*) FILTER (label='ASD') AS asd_count, count(*) FILTER (label='CONTROL') AS control_count,
count(*) FILTER (sex='Male') AS male_count, count(*) FILTER (sex='Female') AS female_count, round(coalesce(avg(age),0),6) AS mean_age, (SELECT string_agg(site || '=' || n, ',' ORDER BY site || '=' || n) FROM (SELECT site, count(*) n FROM idx GROUP BY site)) AS sites FROM idx""")
def _(spark, sf):
    stats = balance.cohort_statistics(index(spark, sf))
    pairs = F.transform(F.map_entries("site_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.withColumn("mean_age", r6("mean_age")).withColumn("sites", F.array_join(F.array_sort(pairs), ",")).drop("site_distribution")


@query("A17_split_balance", f"WITH {STRAT} SELECT split, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS total FROM sp GROUP BY split, label")
def _(spark, sf):
    subs = subjects(spark, sf)
    parts = splits.stratified_split(subs, "subject_id", "label").drop("label")
    return balance.membership_balance(parts, subs, ["split"], "subject_id", "label")


@query("A17_fold_balance", f"WITH {ROLES} SELECT fold, role, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY fold, role) AS BIGINT) AS total FROM roles JOIN s USING (subject_id) GROUP BY fold, role, label")
def _(spark, sf):
    return balance.membership_balance(_roles(spark, sf), subjects(spark, sf), ["fold", "role"], "subject_id", "label")


@query("A18_modality_pivot", f"""WITH {MODES}, f AS (SELECT subject_id, file, {MOD_CASE} AS m FROM mods) SELECT subject_id, max(file) FILTER (m='t1') AS t1, max(file) FILTER (m='t1ce') AS t1ce, max(file) FILTER (m='t2') AS t2, max(file) FILTER (m='flair') AS flair, max(file) FILTER (m='mask') AS mask,
coalesce(string_agg(DISTINCT m, ',' ORDER BY m) FILTER (m<>'mask'),'') AS channels, count(*) FILTER (m='mask')>0 AS has_mask FROM f GROUP BY subject_id""")
def _(spark, sf):
    return modality_index(spark, sf).select(
        "subject_id", *[F.try_element_at("channels", F.lit(m)).alias(m) for m in P.MODALITIES], "mask",
        F.array_join("available_channels", ",").alias("channels"), "has_mask",
    )


@query("J13_missing_channel_violations", f"WITH {MODES}, f AS (SELECT subject_id, {MOD_CASE} AS m FROM mods), g AS (SELECT subject_id, CASE WHEN count(*) FILTER (m='t1')=0 THEN 't1' WHEN count(*) FILTER (m='t1ce')=0 THEN 't1ce' WHEN count(*) FILTER (m='t2')=0 THEN 't2' WHEN count(*) FILTER (m='flair')=0 THEN 'flair' END AS modality FROM f GROUP BY subject_id) SELECT * FROM g WHERE modality IS NOT NULL")
def _(spark, sf):
    return cohort.ragged_modalities(modality_index(spark, sf))


@query("W18_batch_packing", """WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal>=0 THEN c_nationkey ELSE -1 END AS label, (row_number() OVER (ORDER BY c_custkey)-1)//16 AS b FROM customer)
SELECT CAST(b AS BIGINT) AS batch, string_agg(c_custkey, ',' ORDER BY c_custkey) AS subjects, string_agg(label, ',' ORDER BY c_custkey) AS labels FROM r GROUP BY b HAVING count(*)=16""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("label")
    )
    packed = cohort.batches(rows, ["subject_id"], 16, ["subject_id", "label"], drop_last=True)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return packed.select("batch", text("subject_id").alias("subjects"), text("label").alias("labels"))


@query("K01_canonical_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS position FROM orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return sorted_rank(rows, ["o_custkey", "o_orderkey"], "position").select("o_orderkey", "position")


@query("K02_first_n", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 40")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").limit(40)


# --- audit ------------------------------------------------------------------------------------

def scan_rows(spark, sf):
    k = F.col("scan_id")
    df = files(spark, sf)
    return df.select(
        F.col("rel").alias("path"), P.folder_subject(F.col("rel")).alias("subject"), P.path_class(F.col("rel")).alias("class"),
        F.when(k % 6 == 0, "dicom").otherwise("nifti").alias("format"), (k % 11 != 0).alias("valid"),
        F.array(*[(1 + (k % m) / 4).cast("double") for m in (3, 4, 5)]).alias("spacing"),
        F.array(F.lit(64), F.lit(64), (16 + k % 3).cast("int")).alias("dims"),
        F.when(k % 5 == 0, "Anonymous_Patient").when(k % 7 == 0, "").otherwise(F.concat(F.lit("P"), F.col("cust").cast("string"))).alias("patient_id"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "").when(k % 4 == 2, "Siemens").otherwise("GE").alias("manufacturer"),
    )


SCANS = f"""{FILES}, sc AS (SELECT rel AS path, CASE WHEN upper(split_part(rel,'/',1)) IN ('AD','CN','CONTROL','TUMOR','AUTISM','NORMAL') THEN split_part(rel,'/',2) ELSE split_part(rel,'/',1) END AS subject, {PATH_CLASS} AS class,
CASE WHEN scan_id%6=0 THEN 'dicom' ELSE 'nifti' END AS format, scan_id%11<>0 AS valid, 1+(scan_id%3)/4.0::DOUBLE s0, 1+(scan_id%4)/4.0::DOUBLE s1, 1+(scan_id%5)/4.0::DOUBLE s2, '64x64x' || (16+scan_id%3) AS dims,
scan_id%5=0 OR scan_id%7=0 AS anon, CASE scan_id%4 WHEN 2 THEN 'Siemens' WHEN 3 THEN 'GE' ELSE 'Unknown' END AS manufacturer FROM files)"""


@query("A08_audit_report", f"""WITH {SCANS}, v AS (SELECT * FROM sc WHERE valid) SELECT (SELECT count(DISTINCT subject) FROM sc) AS total_subjects, (SELECT count(*) FROM sc) AS total_files, (SELECT count(*) FROM sc WHERE NOT valid) AS corrupt_count,
string_agg(DISTINCT format, ',' ORDER BY format) AS formats, string_agg(DISTINCT dims, ',' ORDER BY dims) AS dims, count(*) FILTER (anon) AS missing_metadata_count, round(min(s0),6) AS min0, round(max(s1),6) AS max1, round(avg(s2),6) AS mean2,
(SELECT string_agg(class || '=' || n, ',' ORDER BY class) FROM (SELECT class, count(*) n FROM v GROUP BY class)) AS classes, (SELECT string_agg(manufacturer || '=' || n, ',' ORDER BY manufacturer) FROM (SELECT manufacturer, count(*) n FROM v GROUP BY manufacturer)) AS makers FROM v""")
def _(spark, sf):
    rep = audit.audit_report(scan_rows(spark, sf))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    dims = F.array_sort(F.transform("unique_dimensions", lambda d: F.array_join(d.cast("array<string>"), "x")))
    return rep.select(
        "total_subjects", "total_files", "corrupt_count", F.array_join("formats_present", ",").alias("formats"),
        F.array_join(dims, ",").alias("dims"), "missing_metadata_count", r6(F.col("min_spacing")[0]).alias("min0"),
        r6(F.col("max_spacing")[1]).alias("max1"), r6(F.col("mean_spacing")[2]).alias("mean2"),
        text("class_balance").alias("classes"), text("scanner_manufacturers").alias("makers"),
    )


@query("F04_corrupt_files", f"WITH {SCANS} SELECT path FROM sc WHERE NOT valid")
def _(spark, sf):
    return audit.corrupt_files(scan_rows(spark, sf))


@query("A09_spacing_distribution", f"WITH {SCANS}, u AS (SELECT 0 AS axis, s0 AS s FROM sc WHERE valid UNION ALL SELECT 1, s1 FROM sc WHERE valid UNION ALL SELECT 2, s2 FROM sc WHERE valid) SELECT axis, round(min(s),6) AS min, round(max(s),6) AS max, round(avg(s),6) AS mean FROM u GROUP BY axis")
def _(spark, sf):
    d = audit.spacing_distribution(scan_rows(spark, sf))
    return d.select("axis", *[r6(c).alias(c) for c in ("min", "max", "mean")])


@query("A10_distinct_dimensions", f"WITH {SCANS} SELECT DISTINCT dims FROM sc WHERE valid")
def _(spark, sf):
    dims = audit.distinct_dimensions(scan_rows(spark, sf))
    return dims.select(F.array_join(F.col("dims").cast("array<string>"), "x").alias("dims"))


@query("A10_distinct_formats", f"WITH {SCANS} SELECT DISTINCT format FROM sc WHERE valid")
def _(spark, sf):
    return audit.distinct_formats(scan_rows(spark, sf))


@query("A12_manufacturer_histogram", f"WITH {SCANS} SELECT manufacturer, count(*) AS n FROM sc WHERE valid GROUP BY manufacturer")
def _(spark, sf):
    return audit.manufacturer_histogram(scan_rows(spark, sf))


@query("A13_missing_metadata", f"WITH {SCANS} SELECT count(*) FILTER (anon) AS missing_metadata_count FROM sc WHERE valid")
def _(spark, sf):
    return audit.missing_metadata(scan_rows(spark, sf))
