"""Small invented files."""

import gzip
import io
import tarfile

FAMILY = """^DATABASE = Archive
!Database_name = Archive
^SERIES = GSE1
!Series_title = First study
!Series_overall_design = two arms
!Series_supplementary_file = a.tar
!Series_supplementary_file = b.tar
!Series_pubmed_id = 11
!Series_pubmed_id = 12
^PLATFORM = GPL1
!Platform_title = Chip
^SAMPLE = GSM1
!Sample_title = one
!Sample_type = RNA
!Sample_series_id = GSE1
!Sample_series_id = GSE2
!Sample_platform_id = GPL1
!Sample_characteristics_ch1 = tissue: lung
!Sample_description =
!Sample_characteristics_ch1 = age: 3 = old
!sample_table_begin
ID_REF\tVALUE
!not_an_attribute_but_looks_like_one
1\t2
!sample_table_end
!Sample_contact = {long}
^SAMPLE = GSM2
!Sample_title = two
!Sample_type = RNA
!Sample_relation = r1
!Sample_relation = r2
^SAMPLE = GSM3
!Sample_title = three
^SERIES = GSE2
!Series_title = Second study
^SAMPLE = GSM4
!Sample_title = four
!Sample_type = DNA
^SAMPLE = GSM5
!Sample_title = five
^SAMPLE = GSM6
!Sample_title = six
""".replace("{long}", "word " * 1200)

ALONE = "^SAMPLE = GSM9\n!Sample_title = nine\n!Sample_series_id = GSE2\n!Sample_series_id = GSE1\n"
LOST = "^SAMPLE = GSM8\n!Sample_title = eight\n!Sample_series_id = GSE99\n"


def gz(text):
    return gzip.compress(text.encode())


def tar_bytes(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            if content is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


RESULTS = """<html><head><script>var x = "<div class='rprt'>";</script></head><body>
<div class="rprt first"><p class="title">Lung <b>atlas</b> &amp; more</p>
 <div class="supp"><p>(Submitter supplied) We looked at lungs. <a>more...</a></p>
  <dl class="details"><dt>Organism:</dt><dd>Homo sapiens</dd></dl>
  <dl class="details"><dt>Sample Count:</dt><dd> 3 </dd></dl>
  <dl class="details"><dt>Sample Count:</dt><dd>4</dd></dl><div>nested</div></div>
 <div class="aux"><dl class="rprtid"><dt>Accession: </dt><dd>GSE77</dd></dl>
  <dl class="rprtid"><dt>ID:</dt></dl>
  <p class="links"><a href="/geo/x?acc=GSE77">Full Record</a> <a href="http://other/y">Elsewhere</a></p></div></div>
<div class="rprt"><p class="title">No parts<p>second
</div>
<div class="rprt"><p class="title"> Third </p><div class="aux"><dl class="rprtid"><dt>ID:</dt><dd>5</dd></dl></div></div>
</body></html>"""
