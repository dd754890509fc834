"""Word lists and constants that results depend on.

These are data, listed as plain text so that results agree with the published
study the package re-computes. Everything here can be overridden by parameters.
"""

# Domain stopwords, Indonesian function words.
INDONESIAN_STOPWORDS = """
yang dan di ke dari ini itu dengan untuk pada adalah dalam tidak akan juga atau
ada mereka sudah saya kami kita bisa dapat harus seperti oleh karena sebuah satu
dua tiga tersebut serta namun tetapi bahwa lebih telah sangat secara antara
melalui setelah semua hanya
""".split()

# Domain stopwords, academic boilerplate.
ACADEMIC_STOPWORDS = """
penelitian hasil metode data analisis menggunakan berdasarkan menunjukkan
dilakukan digunakan diperoleh mengetahui bertujuan kesimpulan saran pembahasan
pendahuluan
""".split()

# Domain stopwords, English function words.
ENGLISH_STOPWORDS = """
the and of to in is for on with that this are as be by an was at or from it has
have been were which can will also more its their all
""".split()

# The study's own stopwords, by its five headings, in its order. The name of
# its institution is left to the caller.
DOMAIN_STOPWORDS = """
hal salah memiliki sebesar nilai tingkat
inti jenis makna ditemukan membantu meningkatkan
aspek besar kecil utama unit faktor dimensi
terdaftar orang pihak objek tempat hasil jumlah
responden masyarakat pengguna nasabah klien
bisnis usaha industri implementasi analisa
studi kasus positif negatif

pengaruh berpengaruh signifikan berpengaruh_signifikan
variabel variabel_independen variabel_dependen
parsial simultan uji sampel populasi hipotesis hipotesa
menunjukan hubungan perbedaan diterima ditolak
deskriptif periode data rata_rata koefisien

penulis tujuan teori skripsi berjudul menganalisis
studi program_studi universitas perguruan mahasiswa
metode teknik proses prosedur pelaksanaan penerapan
kegiatan pengelolaan perhitungan penilaian evaluasi
laporan pencatatan penelitian
latar belakang masalah rumusan pustaka tinjauan
kerangka berfikir pemikiran pengujian ratio rasio
manajemen akuntansi

tbk persero pt cv jalan perusahaan tahun
indonesia jawa barat timur selatan utara pusat
daerah kabupaten kota provinsi wilayah kecamatan
bandung cimahi jakarta

research company test using value influence
analysis based performance method study product
process service management system abstract used
effect quality
""".split()

BUILT_IN_STOPWORDS = INDONESIAN_STOPWORDS + ACADEMIC_STOPWORDS + ENGLISH_STOPWORDS

# Words expected among the most frequent ones of an uncleaned text.
COMMON_STOPWORDS = """
yang dan di ke dari ini itu dengan untuk pada adalah dalam tidak akan juga atau
ada the and of to in is for on with that this are as by be an was at or from
""".split()

# Indicator words of the quick language guess (strict majority).
QUICK_INDONESIAN = "yang dan dengan untuk adalah dalam pada dari".split()
QUICK_ENGLISH = "the and with for this that from are".split()

# Indicator words of the language guess with a margin of two.
MARGIN_INDONESIAN = "yang dan dengan untuk adalah dalam pada dari ini itu".split()
MARGIN_ENGLISH = "the and with for this that from are is of".split()
LANGUAGE_MARGIN = 2

# Columns of the raw and clean record tables, in order.
RAW_COLUMNS = "identifier title abstract authors date subjects publisher types language source".split()
CLEAN_COLUMNS = "identifier title abstract authors date year subjects publisher types language".split()
FILL_COLUMNS = "authors subjects publisher types language source".split()

# Upper bounds and names of the coherence and similarity bands.
COHERENCE_BANDS = [(0.4, "low"), (0.5, "medium"), (0.6, "good"), (0.7, "very good")]
COHERENCE_TOP_BAND = "excellent"
