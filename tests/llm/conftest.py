import duckdb
import pytest


@pytest.fixture(scope="session")
def rows_of(sf_dir):
    def read(sql):
        return duckdb.sql(sql.replace("@", sf_dir + "/")).fetchall()

    return read


@pytest.fixture(scope="session")
def language_model(rows_of):
    from weftlens.llm.language import fit_languages

    return fit_languages(rows_of("select sample_text, lang from '@lang_sample.parquet'") + rows_of("select sample_text, 'en' from '@reading_label.parquet'"))
