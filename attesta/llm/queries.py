"""The queries of this subpackage and their SQL."""

from attesta.llm.decontaminate import op6_decontaminate
from attesta.llm.html_text import op1_html_text
from attesta.llm.licenses import op2_licenses
from attesta.llm.mixing import op10_mix
from attesta.llm.neardup import op7_near_duplicates
from attesta.llm.oracle import ORACLES  # noqa: F401
from attesta.llm.pseudo_likelihood import op4_pseudo_likelihood
from attesta.llm.quality import op5_quality
from attesta.llm.resampling import op13_resample
from attesta.llm.substrings import op3_substrings
from attesta.llm.token_counts import op12_token_counts
from attesta.llm.token_files import op8_token_files
from attesta.llm.warc import op9_warc
from attesta.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_html_text, op2_licenses, op3_substrings, op4_pseudo_likelihood, op5_quality, op6_decontaminate,
                                   op7_near_duplicates, op8_token_files, op9_warc, op10_mix, op11_whitening, op12_token_counts, op13_resample)}
